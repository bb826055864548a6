"""Frame, scan and table headers as projections of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes as B
from . import markers as M

_QUANT = "array<struct<tq:int,pq:int,q:array<int>>>"
_HUFFMAN = "array<struct<class:int,dest:int,counts:array<int>,symbols:array<int>>>"


def _seq(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _most(payload: Column, size: int) -> Column:
    """So many tables of `size` bytes at least can a segment hold; one, if it is shorter."""
    return F.greatest((F.octet_length(payload) / size).cast("int"), F.lit(1))


def frame(payload: Column) -> Column:
    """struct<precision,height,width,components> of a frame segment; components beyond the payload are left out."""
    n = F.least(B.byte_at(payload, 5), ((F.octet_length(payload) - 6) / 3).cast("int"))
    part = lambda i, k: B.byte_at(payload, i * 3 + 6 + k)
    component = lambda i: F.struct(part(i, 0).alias("id"), B.high_nibble(part(i, 1)).alias("h"), B.low_nibble(part(i, 1)).alias("v"), part(i, 2).alias("tq"))
    none = F.array().cast("array<struct<id:int,h:int,v:int,tq:int>>")
    return F.struct(B.byte_at(payload, 0).alias("precision"), B.be16(payload, 1).alias("height"), B.be16(payload, 3).alias("width"), B.byte_at(payload, 5).alias("declared"), F.when(n > 0, F.transform(_seq(n), component)).otherwise(none).alias("components"))


def scan(payload: Column) -> Column:
    """struct<components,ss,se,ah,al> of a start-of-scan segment; parameters follow 2 bytes per component."""
    n = F.least(B.byte_at(payload, 0), ((F.octet_length(payload) - 1) / 2).cast("int"))
    part = lambda i, k: B.byte_at(payload, i * 2 + 1 + k)
    component = lambda i: F.struct(part(i, 0).alias("id"), B.high_nibble(part(i, 1)).alias("td"), B.low_nibble(part(i, 1)).alias("ta"))
    none = F.array().cast("array<struct<id:int,td:int,ta:int>>")
    tail = B.byte_at(payload, 0) * 2 + 1
    return F.struct(F.when(n > 0, F.transform(_seq(n), component)).otherwise(none).alias("components"), B.byte_at(payload, tail).alias("ss"), B.byte_at(payload, tail + 1).alias("se"), B.high_nibble(B.byte_at(payload, tail + 2)).alias("ah"), B.low_nibble(B.byte_at(payload, tail + 2)).alias("al"))


def quant(payload: Column) -> Column:
    """All tables of one quantization segment, values in zig-zag order; a table that is cut off is left out."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_QUANT).alias("out"))

    def step(acc: Column) -> Column:
        pos = acc["pos"]
        pq, tq = B.high_nibble(B.byte_at(payload, pos)), B.low_nibble(B.byte_at(payload, pos))
        size = F.when(pq == 0, 1).otherwise(2)
        whole = pos + 1 + size * 64 <= F.octet_length(payload)
        values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: B.hex_int(B.slice_bytes(payload, pos + 1 + k * size, size)))
        table = F.struct(tq.alias("tq"), pq.alias("pq"), values.alias("q"))
        return F.when(whole, F.struct((pos + 1 + size * 64).alias("pos"), F.concat(acc["out"], F.array(table)).cast(_QUANT).alias("out"))).otherwise(acc)

    return B.fold(_most(payload, 65), start, step)["out"]


def huffman(payload: Column) -> Column:
    """All tables of one Huffman segment: the 16 counts and the symbols in code order."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_HUFFMAN).alias("out"))

    def step(acc: Column) -> Column:
        pos = acc["pos"]
        counts = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: B.byte_at(payload, pos + k))
        read = F.struct(B.byte_at(payload, pos).alias("head"), counts.alias("counts"), F.aggregate(counts, F.lit(0), lambda a, c: a + c).alias("total"))

        def take(h: Column) -> Column:
            symbols = F.when(h["total"] > 0, F.transform(_seq(h["total"]), lambda k: B.byte_at(payload, pos + 17 + k))).otherwise(F.array().cast("array<int>"))
            table = F.struct(B.high_nibble(h["head"]).alias("class"), B.low_nibble(h["head"]).alias("dest"), h["counts"].alias("counts"), symbols.alias("symbols"))
            whole = pos + 17 + h["total"] <= F.octet_length(payload)
            return F.when(whole, F.struct((pos + 17 + h["total"]).alias("pos"), F.concat(acc["out"], F.array(table)).cast(_HUFFMAN).alias("out"))).otherwise(acc)

        return F.when(pos + 17 <= F.octet_length(payload), B.let(read, take)).otherwise(acc)

    return B.fold(_most(payload, 17), start, step)["out"]


def frames(segs: DataFrame) -> DataFrame:
    """image_id, seq, code, precision, height, width and declared component count of every frame segment."""
    rows = segs.where(F.col("code").between(0xC0, 0xCF) & ~F.col("code").isin(0xC4, 0xC8, 0xCC))
    f = frame(F.col("payload"))
    return rows.withColumn("f", f).select("image_id", "seq", "code", "f.precision", "f.height", "f.width", "f.declared")


def frame_components(segs: DataFrame) -> DataFrame:
    """image_id, pos, id, h, v and tq of every baseline frame component."""
    rows = segs.where(F.col("code") == M.SOF0).select("image_id", F.posexplode(frame(F.col("payload"))["components"]).alias("pos", "c"))
    return rows.select("image_id", "pos", "c.id", "c.h", "c.v", "c.tq")


def scans(segs: DataFrame) -> DataFrame:
    """image_id, seq, n, ss, se, ah and al of every scan; n > 1 means interleaved."""
    rows = segs.where(F.col("code") == M.SOS).withColumn("s", scan(F.col("payload")))
    return rows.select("image_id", "seq", F.size("s.components").alias("n"), "s.ss", "s.se", "s.ah", "s.al")


def scan_components(segs: DataFrame) -> DataFrame:
    """image_id, seq, pos, id, td and ta of every component of every scan."""
    rows = segs.where(F.col("code") == M.SOS).select("image_id", "seq", F.posexplode(scan(F.col("payload"))["components"]).alias("pos", "c"))
    return rows.select("image_id", "seq", "pos", "c.id", "c.td", "c.ta")


def quant_tables(segs: DataFrame) -> DataFrame:
    """image_id, seq, tq, pq and q (zig-zag order) of every quantization table."""
    rows = segs.where(F.col("code") == M.DQT).select("image_id", "seq", F.explode(quant(F.col("payload"))).alias("t"))
    return rows.select("image_id", "seq", "t.tq", "t.pq", "t.q")


def huffman_tables(segs: DataFrame) -> DataFrame:
    """image_id, seq, class (0 DC, 1 AC), dest, counts and symbols of every Huffman table."""
    rows = segs.where(F.col("code") == M.DHT).select("image_id", "seq", F.explode(huffman(F.col("payload"))).alias("t"))
    return rows.select("image_id", "seq", "t.class", "t.dest", "t.counts", "t.symbols")


def quant_lookup(components: DataFrame, tables: DataFrame) -> DataFrame:
    """components with q of their table, the last of that id (Q28), and `error` where there is none."""
    last = tables.groupBy("image_id", "tq").agg(F.max_by("q", "seq").alias("q"))
    rows = components.join(last, ["image_id", "tq"], "left")
    return rows.withColumn("error", F.when(F.col("q").isNull(), "missing_quant_table"))


def huffman_lookup(scan_parts: DataFrame, tables: DataFrame) -> DataFrame:
    """scan components with their DC and AC table, the last before the scan (J3, Q28), and `error` where one is missing."""
    kinds = scan_parts.select("*", F.explode(F.array(F.struct(F.lit(0).alias("class"), F.col("td").alias("dest")), F.struct(F.lit(1).alias("class"), F.col("ta").alias("dest")))).alias("k")).select("*", "k.class", "k.dest").drop("k")
    right = tables.select(F.col("image_id").alias("__i"), F.col("seq").alias("__s"), F.col("class").alias("__c"), F.col("dest").alias("__d"), "counts", "symbols")
    on = (F.col("image_id") == F.col("__i")) & (F.col("class") == F.col("__c")) & (F.col("dest") == F.col("__d")) & (F.col("__s") < F.col("seq"))
    found = kinds.join(right, on, "left").groupBy("image_id", "seq", "pos", "id", "class", "dest").agg(F.max_by(F.struct("counts", "symbols"), "__s").alias("t"))
    return found.select("image_id", "seq", "pos", "id", "class", "dest", "t.counts", "t.symbols", F.when(F.col("t").isNull(), "missing_huffman_table").alias("error"))
