"""Operator 1: benchmark decontamination by size-partitioned MinHash containment search.

Test items are put into partitions by their number of distinct word shingles, (s/2, s] for s = 1, 2, 4, ... A
long document has a tiny Jaccard similarity to a short item, so for each partition it is read in windows of 2 s shingles at
steps of s: any passage as long as an item of the partition lies in one window whole, and an item of
containment t has a similarity to that window of at least t / (5 - t), whatever the document's length. The MinHash
values of windows are minima over blocks of the smallest partition, merged upwards. A window and an item that agree in one of
`functions(t)` values are a candidate; a candidate is verified by the share of the item's distinct shingles that the
whole document holds. Candidates missed: under MISS for a passage in one place.

The items are the query set. They are read in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES of text, or one longer item, and each block is searched
for in one pass over the documents, without any exchange of texts; more items mean more passes, not more memory. An index takes about
ten bytes for each byte of its items, so what is broadcast is bounded, too.

Defined results: texts and items of fewer than five words (null and empty ones among them) have no shingle and match
nothing; equal items and equal documents each give rows of their own; an empty table gives no row. Other columns are ignored,
and a document column named like an item column does no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pieces
from .text import mix, shingles, words

WIDTH = 5
THRESHOLD = 0.8
MISS = 1e-5
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20


def functions(threshold: float) -> int:
    """How many MinHash values make a candidate of a contained item, but for a chance of MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold / (5 - threshold)))


class Index:
    """The items of one block: their shingles, and for each partition and function their MinHash values."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: float):
        self.ids, self.sets, self.threshold = ids, sets, threshold
        k = functions(threshold)
        self.factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        sizes = np.array([len(x) for x in sets], np.int64)
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        mins = np.array([[(x * f).min() for f in self.factors] for x in sets], np.uint64).reshape(len(sets), k)
        upper = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        for s in np.unique(upper).tolist():
            own = np.flatnonzero(upper == s)
            tables = []
            for j in range(k):
                order = own[np.argsort(mins[own, j])]
                gate = np.zeros(1 << 16, bool)  # most windows' values end here
                gate[(mins[own, j] & np.uint64(0xFFFF)).astype(np.int64)] = True
                tables.append((mins[order, j], order, gate))
            self.partitions[s] = tables

    def search(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shingles found) of all pairs that reach the threshold."""
        x, offsets = shingles(*words(column), WIDTH)
        pairs: list[np.ndarray] = []
        counts = np.diff(offsets)
        if len(x) and self.partitions:
            base = min(self.partitions)
            starts, rows, lengths = _cut(offsets, base)
            for j, factor in enumerate(self.factors):
                values, size, n = np.minimum.reduceat(x * factor, starts), base, lengths
                row = rows
                while size <= max(self.partitions):
                    if size in self.partitions:
                        pairs.append(self._agree(self.partitions[size][j], values, row))
                    ends = np.concatenate([[0], np.cumsum(n)])
                    pick, row, n = _cut(ends, 2, np.arange(len(n)))
                    values, size = np.minimum.reduceat(values, pick), 2 * size
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        rows, items = found // len(self.ids) if len(found) else found, found % max(len(self.ids), 1)
        held = np.zeros(len(found), np.int64)
        for r in np.unique(rows).tolist():
            own = np.sort(x[offsets[r] : offsets[r] + counts[r]])
            for k in np.flatnonzero(rows == r).tolist():
                item = self.sets[items[k]]
                at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                held[k] = int((own[at] == item).sum())
        sizes = np.array([len(s) for s in self.sets], np.int64)
        good = held >= np.ceil(self.threshold * sizes[items] - 1e-9) if len(found) else np.zeros(0, bool)
        return rows[good], items[good], held[good]

    def _agree(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], values: np.ndarray, row: np.ndarray) -> np.ndarray:
        """row * items + item where a window (a block with the next one) has the item's value."""
        keys, order, gate = table
        # A window's minimum equals the item's value only if one of its two blocks has it.
        some = np.flatnonzero(gate[(values & np.uint64(0xFFFF)).astype(np.int64)])
        low = np.searchsorted(keys, values[some], side="left")
        high = np.searchsorted(keys, values[some], side="right")
        some, low, high = some[high > low], low[high > low], high[high > low]
        if not len(some):
            return np.empty(0, np.int64)
        before = np.where((some > 0) & (row[np.maximum(some - 1, 0)] == row[some]), values[np.maximum(some - 1, 0)], np.uint64(2**64 - 1))
        last = np.minimum(some + 1, len(values) - 1)
        after = np.where((some + 1 < len(values)) & (row[last] == row[some]), values[last], np.uint64(2**64 - 1))
        lowest = (values[some] <= before) | (values[some] <= after)
        some, low, high = some[lowest], low[lowest], high[lowest]
        times = high - low
        at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(row[some], times) * len(self.ids) + order[at]


def _cut(offsets: np.ndarray, size: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of `size` within each row that isn't empty: their starts, their rows and the number in each row."""
    counts = np.diff(offsets)
    blocks = -(-counts // size)
    total = int(blocks.sum())
    row = np.repeat(np.arange(len(counts)), blocks)
    within = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return offsets[row] + within * size, row, blocks


def indexes(items: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text", block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The items' index, block by block in the order of the table; a block is what is held in memory and sent to the executors at once."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("octet_length(text) > 0")
    ids, sets, size = [], [], 0
    for row in rows.toLocalIterator():  # a partition at a time
        length = len(row["text"].encode())
        if ids and (len(ids) == block_items or size + length > block_bytes):
            yield Index(ids, sets, threshold)
            ids, sets, size = [], [], 0
        x, _ = shingles(*words(pa.array([row["text"]])), WIDTH)
        if len(x):
            ids.append(row["id"])
            sets.append(np.unique(x))
            size += length
    if ids:
        yield Index(ids, sets, threshold)


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc id, item id, item_shingles, found_shingles and containment of every pair that reaches the threshold."""
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    schema = f"doc_id {kind}, item_id {item_kind}, item_shingles int, found_shingles int, containment double"
    spark = docs.sparkSession
    out = None
    for index in indexes(items, threshold, item_id_col, item_text_col):
        sent = spark.sparkContext.broadcast(index)  # at most BLOCK_ITEMS items and BLOCK_BYTES
        item_type = pa.array(index.ids).type

        def run(batches: Iterator[pa.RecordBatch], sent=sent, item_type=item_type) -> Iterator[pa.RecordBatch]:
            own = sent.value
            sizes = np.array([len(s) for s in own.sets])
            for batch in pieces(batches, text_col):
                rows, found, held = own.search(batch.column(text_col))
                size = sizes[found] if len(found) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows)), pa.array([own.ids[i] for i in found], item_type), pa.array(size.astype(np.int32)), pa.array(held.astype(np.int32)), pa.array(held / np.maximum(size, 1))], names=["doc_id", "item_id", "item_shingles", "found_shingles", "containment"])

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for index in indexes(items, threshold, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col):
                keep = np.ones(len(batch), bool)
                keep[sent.value.search(batch.column(text_col))[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
