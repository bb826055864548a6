"""Operator 5: all pairs of vectors with a cosine similarity of 0.9 or more, by random-hyperplane sign hashing.

Vectors with equal components are one class, which takes part once, by its smallest vec_id, with the number of its copies. In
each of `tables(bits)` tables, with bits from the number of classes, a class is put into the bucket of the signs of `bits` projections on
random hyperplanes; two vectors at the threshold agree in a table with probability (1 - angle / pi) ** bits, and
miss each other in all with a chance under MISS. Within a bucket all pairs are
verified by their cosine in double precision; a link is counted in the first table in which the pair meets, which the codes of linked vectors, made anew
there, tell. Buckets are found and cut on (bucket, vector number) rows alone, and a vector is sent once for each bucket that others are in. Pairs are never rows: large buckets are cut into pairs of blocks, and a block pair
returns each member's number of links and a spanning forest, which distributed connected components join.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and vectors of another
length than their partner, link with nothing; rows with a null vec_id are not searched and not returned; rows
with equal vec_id count as vectors of their own; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import block_pairs, components, forest, join_hot, units
from .tables import deal, materialize

THRESHOLD = 0.9
#: Vectors without a partner that share a bucket by chance, about.
BUCKET = 64
MISS = 1e-5
BLOCK = 2048
SEED = 11


def bits_for(classes: int) -> int:
    """Bits that leave about BUCKET unrelated vectors in a bucket, so work grows with a power well under two."""
    return min(max(4, math.ceil(math.log2(max(classes, 1) / BUCKET))), 32)


def tables(bits: int, threshold: float) -> int:
    """How many tables leave a pair at the threshold unmet with a chance under MISS."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log(1 - agree))


def planes(size: int, bits: int, count: int) -> np.ndarray:
    """The hyperplanes' normals, equal in every process."""
    return np.random.Generator(np.random.PCG64(SEED + size)).standard_normal((size, bits * count))


def decode(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors as doubles; None where a vector links with nothing."""
    out: list[np.ndarray | None] = []
    for x in column:
        own = x.values if x.is_valid else None
        if own is None or not len(own) or own.null_count:
            out.append(None)
            continue
        v = own.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if np.isfinite(v).all() and v.any() else None)
    return out


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and the vector as packed doubles (null: links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if v is None else (v + 0.0).tobytes() for v in decode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    kind = dict(vectors.dtypes)[id_col]
    return vectors.where(F.col(id_col).isNotNull()).select(id_col, vector_col).mapInArrow(run, f"vec_id {kind}, v binary")


def unit_rows(packed: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of length 1; scaled first, so squares neither overflow nor vanish."""
    m = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def codes(rows: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The signs of unit rows in `count` tables, as numbers of `bits` bits; equal however many rows are coded together."""
    made = np.zeros((len(rows), count), np.uint32)
    normals = planes(rows.shape[1], bits, count)
    for start in range(0, len(rows), 256):
        part = np.zeros((256, rows.shape[1]))  # of one shape, so a row's sums are the same in every call
        own = rows[start : start + 256]
        part[: len(own)] = own
        signs = (part @ normals >= 0)[: len(own)]
        made[start : start + 256] = (signs.reshape(len(own), count, bits) * (1 << np.arange(bits))).sum(2)
    return made


def hashed(reps: DataFrame, bits: int, threshold: float) -> DataFrame:
    """bucket and cid: a row for each table of each vector."""
    count = tables(bits, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                packed = batch.column("v").to_pylist()
                lengths = np.array([len(p) for p in packed])
                own = np.zeros((len(packed), count), np.uint32)
                for size in np.unique(lengths).tolist():
                    some = np.flatnonzero(lengths == size)
                    own[some] = codes(unit_rows([packed[i] for i in some]), bits, count)
                key = (np.arange(count, dtype=np.int64)[None, :] << 40) | own
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("cid").take(pa.array(np.repeat(np.arange(len(packed)), count)))], names=["bucket", "cid"])

    return reps.select("cid", "v").mapInArrow(run, "bucket long, cid long")


def thin(packed: bytes) -> bytes:
    """Packed doubles that hold floats, as most do, at half the size."""
    wide = np.frombuffer(packed, np.float64)
    with np.errstate(over="ignore"):
        narrow = wide.astype(np.float32)
    return narrow.tobytes() if narrow.astype(np.float64).tobytes() == packed else packed


def close(unit: pa.Table, bits: int, count: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a unit at the threshold that agree in no earlier table."""
    tab = unit.column("bucket")[0].as_py() >> 40
    sizes = unit.column("size").to_numpy()
    vectors = unit.column("v").to_pylist()
    one = unit.column("lo")[0].as_py() == unit.column("hi")[0].as_py()
    side = unit.column("own").to_numpy() == unit.column("hi")[0].as_py()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for size in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == size)
        rows = unit_rows([v if len(v) == 8 * size else np.frombuffer(v, np.float32).astype(np.float64).tobytes() for v in (vectors[k] for k in some.tolist())])
        left, right = (np.arange(len(some)),) * 2 if one else (np.flatnonzero(~side[some]), np.flatnonzero(side[some]))
        made = np.zeros((len(some), 0), np.uint32)
        coded = np.zeros(len(some), bool)
        for start in range(0, len(left), 512):
            own = left[start : start + 512]
            i, j = np.nonzero(rows[own] @ rows[right].T >= threshold)
            a, b = own[i], right[j]
            if one:
                a, b = a[a < b], b[a < b]
            if tab and len(a):
                if not made.shape[1]:
                    made = np.zeros((len(some), count), np.uint32)
                new = np.zeros(len(some), bool)
                new[a] = new[b] = True
                new = np.flatnonzero(new & ~coded)
                made[new] = codes(rows[new], bits, count)
                coded[new] = True
                for t in range(0, tab, 8):
                    first = ~(made[a, t : min(t + 8, tab)] == made[b, t : min(t + 8, tab)]).any(1)
                    a, b = a[first], b[first]
            found.append((some[a], some[b]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def cosine_links(vectors: DataFrame, threshold: float = THRESHOLD, bits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept, one row per vector."""
    rows = materialize(classes(vectors, id_col, vector_col).withColumn("h", F.sha1("v")), "vectors")
    reps = rows.where("v IS NOT NULL").groupBy("h").agg(F.min(F.struct("vec_id", "v")).alias("low"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("cid"), "h", "copies", "low.vec_id", "low.v"), "vector-classes")
    many = reps.count()
    bits = bits_for(many) if bits is None else bits
    count = tables(bits, threshold)
    kind = dict(reps.dtypes)["vec_id"]
    keys = ["bucket", "lo", "hi"]

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("v").to_pylist()
            sizes = pa.array([len(p) // 8 for p in packed], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sizes, pa.array([thin(p) for p in packed], pa.binary())], names=["cid", "vec_id", "copies", "size", "v"])

    packed = reps.select("cid", "vec_id", "copies", "v").mapInArrow(slim, f"cid long, vec_id {kind}, copies long, size int, v binary")
    pairs = block_pairs(hashed(reps, bits, threshold), "bucket", "cid", BLOCK, many * count).select(*keys, "own", "cid")
    pairs = deal(pairs.join(packed, "cid").select(*keys, "own", "cid", "vec_id", "copies", "size", "v"), *keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 3):
            if len(unit) < 2:
                continue
            i, j = close(unit, bits, count, threshold)
            if not len(i):
                continue
            ids = pa.StructArray.from_arrays([unit.column(c).combine_chunks() for c in ("vec_id", "cid")], names=["vec_id", "cid"])
            copies = unit.column("copies").to_numpy()
            links = np.zeros(len(unit), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = forest(len(unit), i, j)
            linked, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(unit)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids.take(pa.array(linked)), ids.take(pa.array(child))]), pa.concat_arrays([pa.nulls(len(linked), ids.type), ids.take(pa.array(root[child]))]), pa.array(np.concatenate([links[linked], np.zeros(len(child), np.int64)]))], names=["a", "b", "links"])

    node = f"struct<vec_id:{kind},cid:bigint>"
    found = materialize(pairs.mapInArrow(compare, f"a {node}, b {node}, links long"), "vector-links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    extra = counts.join(parts, F.col("a") == F.col("id"), "left").select(F.col("a.cid").alias("cid"), "links", F.col("component.vec_id").alias("component"))
    by_class = reps.select("cid", "h", F.col("vec_id").alias("first"), "copies").join(extra, "cid", "left").drop("cid")
    some = rows.where("h IS NOT NULL").select("vec_id", "h")
    out = join_hot(some, by_class, ["h"], "copies", some.count()).select("vec_id", "first", "copies", "links", "component")
    none = rows.where("h IS NULL").select("vec_id", F.col("vec_id").alias("first"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("links"), F.col("vec_id").alias("component"))
    label = F.coalesce("component", "first")
    return out.unionByName(none).select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), label.alias("component_id"), (label == F.col("vec_id")).alias("kept"))
