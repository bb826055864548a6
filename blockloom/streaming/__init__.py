"""Images that keep arriving: the header projections are stateless, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import headers, segments

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_images(spark: SparkSession, path: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """New files below `path` as a stream of image_id and content."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("path").alias("image_id"), "content", "length")


def stream_frames(images: DataFrame) -> DataFrame:
    """Frame headers of a stream of images."""
    return headers.frames(segments.segments(segments.parse(images)))
