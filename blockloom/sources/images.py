"""Image bytes as rows (S1-S3): image_id and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = "X'FFD8'"


def read_images(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """The files below `path`, one row each, from any store that Spark reads. The file's path is its image_id."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(F.col("path").alias("image_id"), "content", "length")


def images_from(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Any table with a BINARY column as images."""
    return df.select(F.col(id_col).cast("string").alias("image_id"), F.col(content_col).alias("content"), F.octet_length(content_col).cast("long").alias("length"))


def has_magic(content: str = "content"):
    """True where the bytes begin with the start-of-image marker; false, not null, for null or short bytes."""
    return F.coalesce(F.substring(F.col(content), 1, 2) == F.expr(MAGIC), F.lit(False))
