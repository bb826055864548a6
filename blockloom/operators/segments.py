"""Segments of image streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..sources.images import has_magic
from . import markers as M

_SEG = "struct<seq:int,code:int,off:int,len:int,payload:binary,data:binary>"
#: A marker that ends entropy-coded data: FF and a byte that is neither 00, FF nor a restart's.
_END_OF_SCAN = "\\xFF[^\\x00\\xFF\\xD0-\\xD7]"


def scan_markers(images: DataFrame) -> DataFrame:
    """image_id, pos and code of every marker-like byte pair, payloads and entropy data included (S4 raw)."""
    return images.select("image_id", F.explode(B.marker_positions(F.col("content"))).alias("m")).select("image_id", "m.pos", "m.code")


def parse(images: DataFrame) -> DataFrame:
    """images with `segs` (all segments in stream order) and `fault` (why the hop ended early, null if it did not).

    The hop goes from marker to marker by segment lengths, as a fold inside one row: there is no exchange, no recursion
    limit, and an embedded stream inside a payload is not taken for segments. A start-of-scan's `data` holds
    the bytes up to the marker that ends its entropy-coded data. The fold's state is a few numbers and a string of places, which
    is cut into segments once at its end, so a step doesn't copy the segments before.
    """
    content = F.col("content")
    n = F.octet_length(content)
    state = lambda pos, done, fault, places: F.struct(pos.cast("int").alias("pos"), done.alias("done"), fault.cast("string").alias("fault"), places.alias("places"))
    start = state(F.lit(2), F.lit(False), F.lit(None), F.lit(""))

    def step(acc):
        pos = acc["pos"]
        read = F.struct(B.byte_at(content, pos).alias("lead"), B.byte_at(content, pos + 1).alias("code"), B.be16(content, pos + 2).alias("length"))
        return F.when(acc["done"], acc).otherwise(B.let(read, lambda h: advance(acc, h)))

    def advance(acc, h):
        pos, code, length = acc["pos"], h["code"], h["length"]
        fill = (h["lead"] == 0xFF) & (code == 0xFF)
        alone = ~M.is_segment(code)
        fault = (
            F.when(pos >= n, "no_end_of_image").when(code.isNull(), "truncated").when((h["lead"] != 0xFF) | (code == 0), "no_marker")
            .when(fill | alone, F.lit(None)).when(length.isNull(), "truncated").when(length < 2, "bad_length").when(pos + 2 + length > n, "truncated").cast("string")
        )
        end = F.when(alone, pos + 2).otherwise(pos + 2 + length)
        after = F.when(code == M.SOS, entropy_end(end)).otherwise(end)

        def settle(at):
            taken = F.concat(acc["places"], F.concat_ws(":", pos, at["end"], at["after"]), F.lit(","))
            return (
                F.when(at["fault"].isNotNull(), state(pos, F.lit(True), at["fault"], acc["places"]))
                .when(fill, state(pos + 1, F.lit(False), F.lit(None), acc["places"]))
                .otherwise(state(at["after"], code == M.EOI, F.lit(None), taken))
            )

        ends = F.when(fault.isNull() & ~fill, F.struct(end.alias("end"), after.alias("after")))
        return B.let(F.struct(fault.alias("fault"), ends.alias("ends")), lambda at: settle({"fault": at["fault"], "end": at["ends"]["end"], "after": at["ends"]["after"]}))

    def entropy_end(after):
        rest = B.latin(F.substring(content, after + 1, n))
        return B.let(F.regexp_instr(rest, F.lit(_END_OF_SCAN)), lambda stop: F.when(stop > 0, after + stop - 1).otherwise(n))

    def segment(place, seq):
        def made(at):
            pos, end, after = (F.get(at, k) for k in range(3))
            code = B.byte_at(content, pos + 1)
            off = F.when(M.is_segment(code), pos + 4).otherwise(pos + 2)
            data = F.when(code == M.SOS, B.slice_bytes(content, end, after - end))
            return F.struct(seq.alias("seq"), code.alias("code"), off.alias("off"), (end - off).alias("len"), B.slice_bytes(content, off, end - off).alias("payload"), data.alias("data")).cast(_SEG)

        return B.let(F.split(place, ":").cast("array<int>"), made)

    # No more steps than there are FF bytes that aren't stuffed, and one that sees the end.
    lead = F.regexp_count(B.latin(content), F.lit("\\xFF(?!\\x00)"))
    hop = F.when(has_magic(), B.fold(lead + 1, start, step))
    rows = B.once(images, __s=hop)
    fault = F.when(F.col("__s").isNull(), "no_start_of_image").when(F.col("__s.fault").isNotNull(), F.col("__s.fault")).when(~F.col("__s.done"), "no_end_of_image")
    places = F.filter(F.split("__s.places", ","), lambda x: x != "")
    segs = F.coalesce(F.transform(places, segment), F.array().cast(f"array<{_SEG}>"))
    return B.once(rows, fault=fault, segs=segs).drop("__s")


def segments(parsed: DataFrame) -> DataFrame:
    """image_id, seq, code, off, len and payload: the long table of all segments."""
    return parsed.select("image_id", F.explode("segs").alias("s")).select("image_id", "s.seq", "s.code", "s.off", "s.len", "s.payload")


def groups(segs: DataFrame) -> DataFrame:
    """image_id, code and the (off, len) of each of its segments in stream order (A1)."""
    grouped = segs.groupBy("image_id", "code").agg(F.sort_array(F.collect_list(F.struct("seq", "off", "len"))).alias("all"))
    return grouped.select("image_id", "code", F.transform("all", lambda s: F.struct(s["off"].alias("off"), s["len"].alias("len"))).alias("segments"))


def first_only(segs: DataFrame) -> DataFrame:
    """The first segment of each code that a frame may have once, and all of the others."""
    # One group a repeated segment, one a code for the others, so the segments are parsed once.
    which = F.when(M.is_singleton(F.col("code")), -1).otherwise(F.col("seq"))
    kept = segs.groupBy("image_id", "code", which.alias("__which")).agg(F.min(F.struct("seq", "off", "len")).alias("s"))
    return kept.select("image_id", "code", "s.seq", "s.off", "s.len")


def of_code(segs: DataFrame, code: int) -> DataFrame:
    """The segments of one marker."""
    return segs.where(F.col("code") == code)
