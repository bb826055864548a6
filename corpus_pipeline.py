"""A training corpus from raw documents: five stages, each one operator of blockloom.llm.

1. toxicity: documents that the grammar rejects (score 0.3 or more) go. It learns from the labels of documents outside
   the held-out quarter that the stage is given.
2. n-gram Jaccard join: of documents that links of similarity 0.8 or more connect, the smallest doc_id stays.
3. suffix-array dedup: strings of 50 bytes that also start in a document with a smaller doc_id are cut out. Characters stay
   whole and n_chars is set anew; a document of which nothing is left stays with an empty text.
4. benchmark decontamination: documents that hold 0.8 or more of a test item's five-word shingles go.
5. mixing: the sources get equal weight, by Poisson replication and a global shuffle.

Every stage reads all that its predecessor kept and returns the columns of documents, the last with copy and
shuffle_key besides. Documents with null texts or ids pass the filters; the defined results are in the operators' texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import decontamination, mixing, near_text, suffixes, toxicity
from blockloom.llm.tables import delete, materialize, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_harmless(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cut(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
]

#: Learning, similarity classes and repeated strings go beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's own tables, and its input, are deleted once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scope(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            written = made.pop()
        delete(spark, last)
        last = [written]
    return docs
