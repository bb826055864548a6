"""Marker codes, their classes and the coding processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOF0, SOF1, DHT, SOI, EOI, SOS, DQT, DRI = 0xC0, 0xC1, 0xC4, 0xD8, 0xD9, 0xDA, 0xDB, 0xDD


def name(code: Column) -> Column:
    """The marker's name in ITU-T T.81 Table B.1."""
    hexed = F.hex(code)
    return (
        F.when(code == 0x01, "TEM").when(code < 0xC0, F.concat(F.lit("RES"), code.cast("string")))
        .when(code == 0xC4, "DHT").when(code == 0xC8, "JPG").when(code == 0xCC, "DAC")
        .when(code < 0xD0, F.concat(F.lit("SOF"), (code - 0xC0).cast("string")))
        .when(code < 0xD8, F.concat(F.lit("RST"), (code - 0xD0).cast("string")))
        .when(code < 0xE0, F.element_at(F.array(*map(F.lit, "SOI EOI SOS DQT DNL DRI DHP EXP".split())), (code - 0xD7).cast("int")))
        .when(code < 0xF0, F.concat(F.lit("APP"), F.right(hexed, F.lit(1))))
        .when(code < 0xFE, F.concat(F.lit("JPG"), (code - 0xF0).cast("string")))
        .when(code == 0xFE, "COM")
    )


def is_segment(code: Column) -> Column:
    """False for markers that stand alone: TEM, RSTn, SOI and EOI."""
    return ~((code == 0x01) | code.between(0xD0, 0xD9))


def is_singleton(code: Column) -> Column:
    """False for markers that a frame may repeat: DHT, DAC, DQT and EXP."""
    return ~code.isin(0xC4, 0xCC, 0xDB, 0xDF)


def markers(spark: SparkSession) -> DataFrame:
    """code, name, is_segment and is_singleton of the 254 codes 01..FE."""
    code = F.col("id").cast("int")
    return spark.range(1, 255).select(code.alias("code"), name(code).alias("name"), is_segment(code).alias("is_segment"), is_singleton(code).alias("is_singleton"))


def process(code: Column) -> Column:
    """struct<process, coding> that a frame marker names; null for others (P10)."""
    known = F.when(code == SOF0, "baseline").when(code == SOF1, "extended_sequential")
    return F.when(known.isNotNull(), F.struct(known.alias("process"), F.lit("huffman").alias("coding")))


def processes(spark: SparkSession) -> DataFrame:
    """What a coding process allows."""
    rows = [("baseline", True, False, True, False, True, False, 2, 2), ("extended_sequential", True, True, True, True, True, True, 4, 4)]
    return spark.createDataFrame(rows, "process string, eight_bit boolean, sixteen_bit boolean, sequential boolean, progressive boolean, huffman boolean, arithmetic boolean, ac_tables int, dc_tables int")
