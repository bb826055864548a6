"""Operator 9: mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the input. Each
document draws u in [0, 1) from a hash of (seed, doc_id) and gets the number of copies k at
which the Poisson distribution of that mean first exceeds u; the rows are exploded by k and dealt
out anew by a hash of (seed, doc_id, copy), which shuffles them over all partitions.

The rates need one row per source, found by a partially aggregated count over all documents. Where the sources are
named in the target (an argument) or number at most BROADCAST_SOURCES, which is counted first, their table is broadcast and no
document moves by its source; otherwise the joins leave the rows of hot sources where they are.
A document of a rare source may have millions of copies: beyond SLICE parts its draws are dealt out in slices over all tasks, and
a running sum over its slices numbers the copies.

Defined results: a null source is a source of its own, named None in a target; a null text is kept as it is;
rows with equal doc_id draw alike; without a target each source has the same weight; sources whose weight is missing
or zero give no rows; weights of absent sources are left out and the rest rescaled; an empty table gives an empty result.
Input columns named like `copy` or `shuffle_key` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import join_hot
from .tables import materialize

#: Means above this are split into equal parts with draws of their own (a sum of Poisson variables is Poisson).
PART_MEAN = 32.0
#: Parts of a document's draws that one row takes.
SLICE = 1024
#: So many sources at most are broadcast.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of the MD5 of the parts, joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_steps(mean: Column) -> Column:
    """The values P(X <= k), k = 0, 1, ..., up to where a 52-bit draw cannot lie beyond them."""
    terms = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(terms, start, more, lambda acc: acc["all"])


def rates(docs: DataFrame, target: dict | None, source_col: str = "source") -> DataFrame:
    """__source, __parts and __steps: how to draw the copies of a source's documents."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if target is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        cases = F.lit(0.0)
        for name, weight in target.items():
            hit = F.col("source").isNull() if name is None else F.col("source") == F.lit(name)
            cases = F.when(hit, F.lit(float(weight))).otherwise(cases)
        counts = counts.withColumn("weight", cases).where("weight > 0")
    totals = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    shares = counts.crossJoin(F.broadcast(totals))  # one row
    mean = F.col("weight") / F.col("all_weight") * F.col("all_n") / F.col("n")
    shares = shares.withColumn("mean", mean).withColumn("parts", F.greatest(F.ceil(F.col("mean") / PART_MEAN), F.lit(1)).cast("int"))
    return shares.select(F.col("source").alias("__source"), F.col("n").alias("__n"), F.col("parts").alias("__parts"), poisson_steps(F.col("mean") / F.col("parts")).alias("__steps"))


def draws(key: Column, first: Column, last: Column, seed: int) -> Column:
    """The sum of a document's Poisson draws of the parts first..last."""
    each = F.transform(F.sequence(first, last), lambda i: uniform(F.lit(str(seed)), key, i.cast("string")))
    return F.aggregate(each, F.lit(0), lambda acc, u: acc + F.size(F.filter("__steps", lambda c: c <= u)))


def sliced(rows: DataFrame, key: Column, kept: list[str], seed: int) -> DataFrame:
    """kept and copy of documents with many parts: the draws of a slice are a row of their own, dealt out over all tasks."""
    spark = rows.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "rare")  # so many rows that their numbers stay
    ends = F.sequence(F.lit(1), F.col("__parts"), F.lit(SLICE))
    dealt = few.select("__row", key.alias("__key"), "__steps", "__parts", F.explode(ends).alias("__first")).repartition(count, "__row", "__first")
    last = F.least(F.col("__first") + SLICE - 1, F.col("__parts"))
    drawn = materialize(dealt.select("__row", "__first", draws(F.col("__key"), F.col("__first"), last, seed).cast("long").alias("__drawn")), "drawn")
    before = F.sum("__drawn").over(Window.partitionBy("__row").orderBy("__first").rowsBetween(Window.unboundedPreceding, -1))
    placed = drawn.withColumn("__before", F.coalesce(before, F.lit(0))).where("__drawn > 0").repartition(count, "__row", "__first")
    made = placed.join(few.select("__row", *kept), "__row")
    numbers = F.sequence((F.col("__before") + 1).cast("int"), (F.col("__before") + F.col("__drawn")).cast("int"))
    return made.select(*kept, F.explode(numbers).alias("copy"))


def mix_sources(docs: DataFrame, target: dict | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of docs, with `copy` (1..k) and `shuffle_key`, each document k times in a shuffled order.

    The output has as many rows as the input (its sources with weight) on average. target: {source: weight}, of any sum.
    """
    kept = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    table = materialize(rates(docs, target, source_col), "rates")
    known = table.agg(F.count(F.lit(1)).alias("sources"), F.sum("__n").alias("rows"), F.max("__parts").alias("parts")).first()
    inner = {c: f"__mix_{i}" for i, c in enumerate(kept)}  # a document's columns may have any names
    rows, own = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items())), list(inner.values())
    source, key = F.col(inner[source_col]), F.coalesce(F.col(inner[id_col]).cast("string"), F.lit("null"))
    # A broadcast spares the documents a shuffle by source, which hot sources would make uneven.
    if known["sources"] <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(table), source.eqNullSafe(F.col("__source"))).drop("__source", "__n")
    else:
        named = table.where("__source IS NOT NULL").withColumnRenamed("__source", inner[source_col])
        some = join_hot(rows.where(source.isNotNull()), named, [inner[source_col]], "__n", known["rows"]).drop("__n")
        none = F.broadcast(table.where("__source IS NULL").drop("__n"))  # one row at most
        rows = some.unionByName(rows.join(none, source.eqNullSafe(F.col("__source"))).drop("__source"))
    few = rows.where(F.col("__parts") <= SLICE)
    copies = few.withColumn("__copies", draws(key, F.lit(1), F.col("__parts"), seed)).where("__copies > 0")
    out = copies.select(*own, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("copy"))
    if (known["parts"] or 0) > SLICE:
        out = out.unionByName(sliced(rows.where(F.col("__parts") > SLICE), key, own, seed))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.col("copy").cast("string"), F.lit("order"))), 1, 15), 16, 10).cast("long")
    out = out.withColumn("shuffle_key", order).select(*(F.col(i).alias(c) for c, i in inner.items()), "copy", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
