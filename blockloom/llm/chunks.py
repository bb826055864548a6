"""Exact global lookups for keys that lie in chunks of the corpus.

A corpus is written once as a table of *chunks*, a few megabytes of whole documents each, bucketed by chunk. A chunk sends each of
its distinct keys once, packed in one blob per key range; the task that owns a range sees all chunks' entries for
it, and answers each blob with a blob in the same order. So a key that a third of all documents hold
costs one entry per chunk, no task holds more than a range, and positions never travel. Answers are joined to the chunk table,
which its bucketing spares another exchange. There are as many blobs as chunks times ranges, so both grow with the root of the input
(tables.growth) as long as executors have the memory, and the blobs in proportion to it.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import units
from .tables import deal, growth, pieces, scratch_path

CHUNK_BYTES = 4 << 20


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of numbers as one compressed blob; bytes of equal weight lie together."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (count,) = struct.unpack_from("<I", data)
    at, out = 4 + 12 * count, []
    for k in range(count):
        kind, n = struct.unpack_from("<4sQ", data, 4 + 12 * k)
        dtype = np.dtype(kind.decode().strip())
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += n * dtype.itemsize
    return out


def pack_ids(ids: pa.Array) -> bytes:
    """Identifiers of any type, nulls included, as bytes."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_ids(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def deltas(ordered: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, from 0; cumsum() restores it."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def small(values: np.ndarray) -> np.ndarray:
    """Unsigned values in the narrowest type."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def ranges(keys: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """(range number, start, stop) of the parts of ascending 64-bit keys in each of `count` equal key ranges."""
    owner = ((keys >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    cuts = np.searchsorted(owner, np.arange(count + 1, dtype=np.uint64))
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]


class Chunks:
    """A chunk table: chunk (long) and what `make` returns for the documents of each chunk."""

    def __init__(self, docs: DataFrame, size_col: str, make: Callable[[list[pa.RecordBatch]], dict], fields: str, columns: list[str], limit: int | None = None):
        """make: gets the batches of a chunk (columns of docs as named), returns a value for each of `fields`."""
        limit = limit or int(CHUNK_BYTES * growth(docs))
        names = [f.split()[0] for f in fields.split(", ")]
        types = {"binary": pa.binary(), "long": pa.int64()}
        schema = pa.schema([("chunk", pa.int64()), *((f.split()[0], types[f.split()[1]]) for f in fields.split(", "))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, number = [], 0, TaskContext.get().partitionId() << 32

            def row() -> pa.RecordBatch:
                made = make(held)
                return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([made[n]], schema.field(n).type) for n in names)], schema=schema)

            for batch in pieces(batches, size_col):
                held.append(batch)
                size += batch.column(size_col).nbytes
                if size >= limit:
                    yield row()
                    held, size, number = [], 0, number + 1
            if held:
                yield row()

        self.spark = docs.sparkSession
        made = docs.select(*columns).mapInArrow(run, f"chunk long, {fields}")
        path, self.name = scratch_path(self.spark, "chunks"), f"chunks_{uuid.uuid4().hex}"
        # Bucketed by chunk for joins without an exchange; as many buckets as an exchange would have partitions.
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        made.write.bucketBy(self.buckets, "chunk").option("path", path).option("maxRecordsPerFile", 4).option("compression", "uncompressed").saveAsTable(self.name)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def with_answers(self, *answers: DataFrame) -> DataFrame:
        """The table with a column for each exchange's answers: answers0, answers1, ... (arrays of bucket and blob)."""
        out = self.table
        for k, a in enumerate(answers):
            own = a.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "blob"))).alias(f"answers{k}"))
            out = out.join(own, "chunk", "left")
        return out

    def total(self, column: str) -> int:
        return self.table.agg(F.sum(column)).first()[0] or 0


def exchange(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """(chunk, bucket, blob): the answers to sent (bucket, chunk, blob); `answer` sees all blobs of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 1):
            yield pa.RecordBatch.from_arrays([unit.column("chunk").combine_chunks(), unit.column("bucket").combine_chunks(), pa.array(answer(unit.column("blob").to_pylist()), pa.binary())], names=["chunk", "bucket", "blob"])

    return deal(sent, "bucket").mapInArrow(run, "chunk long, bucket long, blob binary")


def sender(emit: Callable[[dict], Iterator[tuple[int, bytes]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that sends what `emit` yields for each row of a chunk table: (bucket, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                sent = list(emit(row))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int64()), pa.array([row["chunk"]] * len(sent), pa.int64()), pa.array([x for _, x in sent], pa.binary())], names=["bucket", "chunk", "blob"])

    return run


SENT = "bucket long, chunk long, blob binary"


def range_count(size: int, each: int) -> int:
    return max(1, math.ceil(size / each))
