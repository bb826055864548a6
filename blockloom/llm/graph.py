"""What the pair operators share: joins on uneven keys, blocks of large groups, runs of sorted keys and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize


#: A key is hot from this share of a join's rows, so there are at most 1,000 hot keys.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined to table on keys, without a task that gets all rows of a hot key.

    table has a row for each key, `weight` says how many of the `total` rows have it. Hot keys' entries, at most
    1 / HOT_SHARE, are broadcast; the rows of the others are exchanged, a thousandth of them at most to one key.
    """
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    side = table.withColumnsRenamed(names)
    hot = side.where(F.col(weight) > total * HOT_SHARE)
    on = [F.col(k) == F.col(own) for k, own in names.items()]
    both = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*names.values())), on, "left_anti").join(side.where(F.col(weight) <= total * HOT_SHARE), on)
    return both.unionByName(rest).drop(*names.values())


def block_pairs(members: DataFrame, key: str, id_col: str, block: int, total: int) -> DataFrame:
    """members with `lo`, `hi` and `own`: the pairs of blocks of its group that a member takes part in.

    A group of n members is cut by hash into ceil(n / block) blocks, and each unordered pair of blocks becomes a unit
    of work (key, lo, hi), so no task holds a large group. A member of a group with b blocks is copied b times.
    Members that are alone in their group are left out. total: the number of members.
    """
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    rows = join_hot(members, sizes, [key], "__n", total)
    blocks: Column = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(id_col), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("lo", F.least("own", "__other")).withColumn("hi", F.greatest("own", "__other")).drop("__n", "__other")


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, which the rows are sorted by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            change[0] = True
        last = tuple(c[-1] for c in columns)
        start = 0
        for cut in np.flatnonzero(change).tolist():
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id reachable, by alternating large and small stars.

    Each round is two partially aggregated minima and two joins and is written to the shared folder, so lineage
    stays short; the number of rounds grows with the logarithm of the longest path. The rows never exceed the edges, and
    the centre of a large star is a hot key of the joins, so its rows stay where they are. Ids may be of any ordered type.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialize(now, "edges")
    for _ in range(rounds):
        split = now.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi")
        upper, lower = now.select(F.col("u").alias("id")).distinct(), now.select(F.col("v").alias("id")).distinct()
        if split.isEmpty() and upper.join(lower, "id", "left_semi").isEmpty():  # each id points to one other, and that to none
            roots = lower.select("id", F.col("id").alias("component"))
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = join_hot(both, low, ["u"], "n", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        small = join_hot(large, low, ["u"], "n", total).select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialize(small, "edges")
    raise RuntimeError("connected components did not settle")
