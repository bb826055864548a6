"""Operator 7: all pairs of documents whose word-shingle sets have a Jaccard similarity of 0.8 or more.

Documents with equal shingle sets (by a 128-bit hash) are one class, which takes part once, by its smallest
doc_id, with the number of its copies. Each class has FUNCTIONS MinHash values. Bands of ROWS values put
classes into buckets; a pair at the threshold misses all of them with a chance of 3e-6. A class is at home in the largest bucket that
a class of one of its buckets is in, and a home of many members is cut by hash into blocks of at most BLOCK members or BLOCK_BYTES, about. Two blocks are
compared if a bucket has members of both, and once, however many buckets they share: a class travels
with its home, and chains of groups that overlap don't grow into one.
Within a pair of blocks, classes are compared by *Bayesian candidate pruning*: after each STEP values the posterior of the
similarity under a uniform prior is Beta(m + 1, n - m + 1) with m of n values equal, and a pair is dropped
once its chance of reaching the threshold is below TOLERANCE. What stays is verified exactly on the shingle sets. Pairs
are never rows: a pair of blocks returns each member's number of
links and a spanning forest of them, which distributed connected components join.

Defined results: a document of one to four words has one shingle, all its words; a text without words (null and
empty ones among them) links with nothing; rows with a null doc_id are not searched and not returned; rows with equal doc_id
count as documents of their own, alike or not, so a repeated row is a copy of the first and is kept or dropped with it; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, forest, join_hot, units
from .tables import deal, materialize, pieces
from .text import mix, shingles_or_whole, words

THRESHOLD = 0.8
BANDS, ROWS = 32, 5
FUNCTIONS = BANDS * ROWS
STEP = 32
TOLERANCE = 1e-6
BLOCK, BLOCK_BYTES = 512, 16 << 20
FACTORS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)


def least_matches(n: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """The least m of n equal values at which the posterior chance of the threshold is `tolerance` or more.

    For whole m, P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m).
    """
    chance = 0.0
    for m in range(n + 1):
        chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if chance >= tolerance:
            return m
    return n


def class_hash(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of an ascending set of shingles."""
    place = np.arange(1, 2 * len(own), 2, dtype=np.uint64)
    return (own * place).sum(), mix(own + place).sum()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the class hash (ha, hb), n (distinct shingles) and sig (FUNCTIONS 32-bit MinHash values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            x, offsets = shingles_or_whole(*words(batch.column(text_col)))
            n, ha, hb = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
            for i in np.flatnonzero(np.diff(offsets)).tolist():
                own = np.unique(x[offsets[i] : offsets[i + 1]])
                n[i] = len(own)
                ha[i], hb[i] = class_hash(own)
            some = np.flatnonzero(n)
            sig = np.zeros((len(some), FUNCTIONS), np.uint32)
            for j, f in enumerate(FACTORS):
                if len(some):
                    sig[:, j] = (np.minimum.reduceat(x * f, offsets[some]) >> np.uint64(8)) & np.uint64(0xFFFFFFFF)
            packed = np.full(len(batch), None, object)
            packed[some] = [row.tobytes() for row in sig]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ha.view(np.int64)), pa.array(hb.view(np.int64)), pa.array(n), pa.array(packed, pa.binary())], names=["doc_id", "ha", "hb", "n", "sig"])

    kind = dict(docs.dtypes)[id_col]
    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ha long, hb long, n int, sig binary")


def buckets(classes: DataFrame) -> DataFrame:
    """cid, n and key of each of the BANDS buckets of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(len(batch), FUNCTIONS).astype(np.uint64)
            keys = np.empty((len(batch), BANDS), np.uint64)
            for b in range(BANDS):
                h = np.full(len(batch), b + 1, np.uint64)
                for j in range(b * ROWS, b * ROWS + ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, j])
                keys[:, b] = h
            again = pa.array(np.repeat(np.arange(len(batch)), BANDS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.array(keys.view(np.int64).ravel())], names=["cid", "n", "key"])

    return classes.select("cid", "n", "sig").mapInArrow(run, "cid long, n int, key long")


def blocks(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, block) of the classes that share a bucket, and (block, lo, hi): the pairs of blocks that each is compared in."""
    rows = buckets(classes)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    held = join_hot(rows, sizes, ["key"], "members", BANDS * classes.count())
    of_class, largest = Window.partitionBy("cid"), F.max(F.struct("members", F.col("key").alias("home")))
    held = materialize(held.withColumn("own", largest.over(of_class)), "buckets")
    # The largest home of a bucket's members is that of all members, so what shares buckets with a large group joins it.
    tops = held.groupBy("key").agg(F.max("own").alias("top"), F.count(F.lit(1)).alias("__n"))
    held = join_hot(held.drop("own", "members"), tops, ["key"], "__n", held.count()).drop("__n")
    first = F.row_number().over(of_class.orderBy("key")) == 1
    held = materialize(held.select("key", "cid", "n", F.max("top").over(of_class)["home"].alias("home"), first.alias("first")), "homes")
    once = lambda x: F.sum(F.when(F.col("first"), x).otherwise(0))
    sizes = held.groupBy("home").agg(once(F.lit(1)).alias("members"), once(F.col("n") * F.lit(8)).alias("bytes"), F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    held = join_hot(held, sizes, ["home"], "__n", held.count())
    held = materialize(held.select("key", "cid", "first", F.xxhash64("home", F.pmod(F.xxhash64("cid"), parts)).alias("block")), "blocks")
    met = held.groupBy("key", "block").agg(F.count(F.lit(1)).alias("__n")).select("key", "block")
    several = met.groupBy("key").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("key")
    met = materialize(met.join(several, "key"), "bucket-blocks")
    cross = met.withColumnRenamed("block", "lo").join(met.withColumnRenamed("block", "hi"), "key").where("lo < hi").select("lo", "hi").distinct()
    both = cross.select(F.explode(F.array("lo", "hi")).alias("block"), "lo", "hi")
    home = held.where("first").select("cid", "block")
    own = home.select("block").distinct().select("block", F.col("block").alias("lo"), F.col("block").alias("hi"))
    return home, own.unionByName(both)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections of the sets."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # values of one set are in no intersection
    keep = often[column]
    row, column = row[keep], np.cumsum(often)[column[keep]] - 1
    width = 4096
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        dense = np.zeros((n, width), np.float32)
        dense[row[a:b], column[a:b] - start] = 1
        out += dense @ dense.T
    return out


def links(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that reach the threshold; with `side`, only pairs with one member on each side."""
    n = len(sets)
    checkpoints = [(k, least_matches(k, threshold)) for k in range(STEP, FUNCTIONS + 1, STEP)]
    left, right = (np.arange(n), np.arange(n)) if side is None else (np.flatnonzero(~side), np.flatnonzero(side))
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(0, len(left), 64):
        rows = left[start : start + 64]
        equal = (sig[rows][:, None, :STEP] == sig[right][None, :, :STEP]).sum(2)
        i, j = np.nonzero(equal >= checkpoints[0][1])
        a, b, m = rows[i], right[j], equal[i, j]
        if side is None:
            a, b, m = a[a < b], b[a < b], m[a < b]
        for k, least in checkpoints[1:]:
            m = m + (sig[a, k - STEP : k] == sig[b, k - STEP : k]).sum(1)
            a, b, m = a[m >= least], b[m >= least], m[m >= least]
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return a, b
    some, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    if len(a) < 4 * len(some) and len(some) > 64:
        both = np.array([np.isin(sets[i], sets[j], assume_unique=True).sum() for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        both = shared([sets[k] for k in some.tolist()])[where[: len(a)], where[len(a) :]]
    good = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-6
    return a[good], b[good]


def link_counts(classes: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b, links): for each class with links their number (b null), and the edges of a spanning forest (links 0).

    a and b: struct<first, cid> of a class, ordered by its smallest doc_id.
    """
    kind = dict(classes.dtypes)["first"]
    home, pairs = blocks(classes)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = classes.join(home, "cid").join(texts, F.col("first") == F.col("__id")).drop("__id")
    kept = ["cid", "first", "copies", "block", "sig"]

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of one row of each class: of rows with the class's doc_id one whose text has its hash."""
        seen: set[int] = set()  # a task's classes
        for batch in pieces(batches, "__text"):
            x, offsets = shingles_or_whole(*words(batch.column("__text")))
            cid, ha, hb, size = (batch.column(c).to_pylist() for c in ("cid", "ha", "hb", "n"))
            some, sets = [], []
            for i in range(len(batch)):
                own = np.unique(x[offsets[i] : offsets[i + 1]])
                if cid[i] in seen or len(own) != size[i] or [int(h.view(np.int64)) for h in class_hash(own)] != [ha[i], hb[i]]:
                    continue
                seen.add(cid[i])
                some.append(i)
                sets.append(own.tobytes())
            picked = batch.select(kept).take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    members = rows.select(*kept, "ha", "hb", "n", "__text").mapInArrow(to_sets, f"cid long, first {kind}, copies long, block long, sig binary, shingles binary")
    rows = deal(members.join(pairs, "block").select("lo", "hi", "block", "cid", "first", "copies", "sig", "shingles"), "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 2):
            unit = unit.take(pa.array(np.unique(unit.column("cid").to_numpy(), return_index=True)[1]))
            if len(unit) < 2:
                continue
            ids = pa.StructArray.from_arrays([unit.column(c).combine_chunks() for c in ("first", "cid")], names=["first", "cid"])
            copies = unit.column("copies").to_numpy()
            sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), np.uint32).reshape(len(unit), FUNCTIONS)
            sets = [np.frombuffer(s, np.uint64) for s in unit.column("shingles").to_pylist()]
            lo, hi = unit.column("lo")[0].as_py(), unit.column("hi")[0].as_py()
            i, j = links(sig, sets, None if lo == hi else unit.column("block").to_numpy() == hi, threshold)
            count = np.zeros(len(unit), np.int64)
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            root = forest(len(unit), i, j)
            linked, child = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(unit)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids.take(pa.array(linked)), ids.take(pa.array(child))]), pa.concat_arrays([pa.nulls(len(linked), ids.type), ids.take(pa.array(root[child]))]), pa.array(np.concatenate([count[linked], np.zeros(len(child), np.int64)]))], names=["a", "b", "links"])

    node = f"struct<first:{kind},cid:bigint>"
    return rows.mapInArrow(compare, f"a {node}, b {node}, links long")


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy_of (smallest doc_id with the same shingles), n_links, class_id (smallest doc_id reachable) and kept.

    n_links counts all other documents at the threshold or above, copies among them.
    """
    sketch = materialize(sketches(docs, id_col, text_col), "sketches")
    same = ["ha", "hb", "n"]
    lowest = F.min(F.struct("doc_id", "sig"))
    classes = sketch.where("n > 0").groupBy(*same).agg(lowest.alias("low"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), *same, F.col("low.doc_id").alias("first"), F.col("low.sig").alias("sig"), "copies"), "classes")
    found = materialize(link_counts(classes, docs, threshold, id_col, text_col), "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"))
    extra = counts.join(parts, F.col("a") == F.col("id"), "left").select(F.col("a.cid").alias("cid"), "links", F.col("component.first").alias("component"))
    by_class = classes.drop("sig").join(extra, "cid", "left").drop("cid")
    some = sketch.where("n > 0").select("doc_id", *same)
    out = join_hot(some, by_class, same, "copies", some.count()).select("doc_id", "first", "copies", "links", "component")
    none = sketch.where("n = 0").select("doc_id", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("long").alias("links"), F.col("doc_id").alias("component"))
    label = F.coalesce("component", "first")
    return out.unionByName(none).select("doc_id", F.col("first").alias("copy_of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), label.alias("class_id"), (label == F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that reach a smaller doc_id by links, with all their columns."""
    gone = jaccard_links(docs, threshold, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
