"""What keeps an image from being decoded, as rows (V1-V4, Q26, Q27, Q29). A bad image never fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from . import headers as H
from . import markers as M


def describe(parsed: DataFrame) -> DataFrame:
    """parsed with `frame` (the last baseline frame), `scan_list`, `quants`, `huffmans`, and `error` (null: decodable).

    A stream without an end-of-image marker is decodable if its scans hold all components.
    """
    of = lambda code: F.filter("segs", lambda s: s["code"] == code)
    other = F.exists("segs", lambda s: s["code"].between(0xC1, 0xCF) & ~s["code"].isin(0xC4, 0xC8, 0xCC))
    rows = B.once(parsed, __sof=F.try_element_at(of(M.SOF0), F.lit(-1))["payload"], __other=other)
    tables = lambda code, parse: F.flatten(F.transform(of(code), lambda s: F.transform(parse(s["payload"]), lambda t: F.struct(s["seq"].alias("seq"), t.alias("t")))))
    frame = F.when(F.col("__sof").isNotNull(), H.frame(F.col("__sof")))
    scans = F.transform(of(M.SOS), lambda s: F.struct(s["seq"].alias("seq"), H.scan(s["payload"]).alias("scan"), s["data"].alias("data")))
    rows = B.once(rows, frame=frame, scan_list=scans, quants=tables(M.DQT, H.quant), huffmans=tables(M.DHT, H.huffman))
    ids = F.transform("frame.components", lambda c: c["id"])
    error = (
        F.when(F.col("fault").isNotNull() & (F.col("fault") != "no_end_of_image"), F.col("fault"))
        .when(F.col("__other"), "unsupported_process")
        .when(F.col("frame").isNull(), "no_frame")
        .when(~_true(F.col("frame.precision") == 8), "unsupported_precision")
        .when(~_true((F.col("frame.height") > 0) & (F.col("frame.width") > 0)), "bad_size")
        .when(~_true(F.col("frame.declared").isin(1, 3) & (F.size("frame.components") == F.col("frame.declared"))), "unsupported_components")
        .when(F.exists("frame.components", lambda c: ~(c["h"].between(1, 4) & c["v"].between(1, 4))), "bad_sampling")
        .when(F.size("scan_list") == 0, "no_scan")
        .when(F.exists("scan_list", lambda s: (F.size(s["scan"]["components"]) == 0) | F.exists(s["scan"]["components"], lambda c: ~F.array_contains(ids, c["id"]))), "scan_component_not_in_frame")
        .when(F.exists("scan_list", lambda s: ~_true((s["scan"]["ss"] == 0) & (s["scan"]["se"] == 63) & (s["scan"]["ah"] == 0) & (s["scan"]["al"] == 0))), "unsupported_scan")
        .when(F.exists(ids, lambda i: ~F.exists("scan_list", lambda s: F.exists(s["scan"]["components"], lambda c: c["id"] == i))), F.coalesce(F.when(F.col("fault").isNotNull(), "truncated"), F.lit("missing_scan")))
        .when(F.exists("quants", lambda t: t["t"]["pq"] != 0), "quant_not_8_bit")
        .when(F.exists("frame.components", lambda c: ~F.exists("quants", lambda t: t["t"]["tq"] == c["tq"])), "missing_quant_table")
    )
    return B.once(rows, error=error).drop("__sof", "__other")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def table_counts(huffman_tables: DataFrame) -> DataFrame:
    """image_id, ac, dc and whether they are a baseline process's two and two (V2, A2)."""
    counts = huffman_tables.groupBy("image_id").agg(F.count_if(F.col("class") == 1).alias("ac"), F.count_if(F.col("class") == 0).alias("dc"))
    return counts.withColumn("baseline_pair", (F.col("ac") == 2) & (F.col("dc") == 2))


def all_eight_bit(quant_tables: DataFrame) -> DataFrame:
    """image_id and whether all its quantization tables are of 8 bits (V3, A3)."""
    return quant_tables.groupBy("image_id").agg(F.bool_and(F.col("pq") == 0).alias("all_eight_bit"))


def errors(described: DataFrame) -> DataFrame:
    """image_id, stage and code of each image that can't be decoded."""
    return described.where("error IS NOT NULL").select("image_id", F.lit("header").alias("stage"), F.col("error").alias("code"))
