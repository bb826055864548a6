"""Where intermediate tables live, and how text batches are cut to a bounded size."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode without it, a temporary folder."""
    there = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="blockloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _root(spark: SparkSession):
    """The application's folder for tables, with its Hadoop file system; it goes when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return path, files


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path, _ = _root(spark)
    path = f"{path.toString()}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _scopes:
        made.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that are made inside, in order; those still in the list at the end are deleted, so take out what is read later."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]
        delete(spark, made)


def delete(spark: SparkSession, paths: list[str]) -> None:
    _, files = _root(spark)
    for path in paths:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors cost no recomputation beyond it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by keys and sorted by them, over as many partitions as spark.sql.shuffle.partitions says.

    The count is explicit, so the partitions aren't joined by their bytes: what follows works far longer on a byte than Spark assumes.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys).sortWithinPartitions(*keys)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all tables that this application materialized, once their results are written; else they go when it ends."""
    for t in spark.catalog.listTables():
        if t.name.startswith("chunks_"):
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    path, files = _root(spark)
    files.delete(path, True)


def growth(df: DataFrame, most: float = 4.0) -> float:
    """By how much units of work grow with the input: the root of its size in GB, from 1 up to `most`.

    The size is the optimizer's estimate, so nothing is read; where it has none the answer is 1.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1.0 if size >= 1 << 60 else min(max(math.sqrt(size / (1 << 30)), 1.0), most)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes in `column`; a longer value makes a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, ends = 0, np.cumsum(sizes)
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
