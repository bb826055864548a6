"""The driver's queries over its tables, each with the same computation in DuckDB SQL.

The tables hold no image bytes. `documents` framed as comment segments give byte streams, `embeddings` of 64 numbers give
8 by 8 blocks, and blocks encoded as gray images give streams that the whole decoder must turn back into their samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bytes as B
from .functions import pixels as P
from .operators import blocks, encode, headers, huffman, segments, validate
from .operators import markers as M
from .plans import decode
from .sources.images import has_magic, images_from

#: A stream of headers: two restart-free scans' worth of tables around a frame of 6 by 2 pixels.
STREAM = (
    b"\xff\xd8"
    + encode.segment(0xE0, b"JFIF\0\1\1\1\0\x48\0\x48\0\0")
    + encode.segment(0xDB, bytes([0, *range(1, 65)]))
    + encode.segment(0xDB, bytes([1, *range(64, 0, -1)]))
    + encode.segment(0xC0, bytes([8, 0, 2, 0, 6, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    + b"".join(encode.segment(0xC4, bytes([kind, *t[0], *t[1]])) for kind, t in ((0x00, encode.DC_LUMA), (0x10, encode.AC_LUMA), (0x01, encode.DC_CHROMA), (0x11, encode.AC_LUMA)))
    + encode.segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))
    + bytes.fromhex("ff0000ff00ff0002046802")
    + b"\xff\xd9"
)

#: The most bytes that a segment holds besides its length.
COMMENT = 65533


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams of up to 3,000 short segments, in turn comments, application data and quantization tables."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.expr("X''"))

    def segment(b, size):
        def one(k):
            part = B.slice_bytes(b, k * size, size)
            return F.concat(F.element_at(F.array(F.lit("FFFE"), F.lit("FFE1"), F.lit("FFDB")), k % 3 + 1), F.lpad(F.hex(F.octet_length(part) + 2), 4, "0"), F.hex(part))

        return one

    def segments_of(b):
        size = F.greatest(F.ceil(F.octet_length(b) / 3000).cast("int"), F.lit(16))
        last = F.greatest(F.ceil(F.octet_length(b) / size).cast("int") - 1, F.lit(0))
        return F.array_join(F.transform(F.sequence(F.lit(0), last), segment(b, size)), "")

    content = F.unhex(F.concat(F.lit("FFD8"), B.let(text, segments_of), F.lit("FFD9")))
    rows = B.once(_read(spark, sf_dir, "documents").select("doc_id", "text"), content=content)
    return images_from(rows, "doc_id", "content")


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams of comment segments: one, or as many as a longer text fills. A null text is an empty one."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.expr("X''"))

    def comments(b):
        def comment(k):
            part = B.slice_bytes(b, k * COMMENT, COMMENT)
            return F.concat(F.lit("FFFE"), F.lpad(F.hex(F.octet_length(part) + 2), 4, "0"), F.hex(part))

        last = F.greatest(F.ceil(F.octet_length(b) / COMMENT).cast("int") - 1, F.lit(0))
        return F.array_join(F.transform(F.sequence(F.lit(0), last), comment), "")

    content = F.unhex(F.concat(F.lit("FFD8"), B.let(text, comments), F.lit("FFD9")))
    return images_from(_read(spark, sf_dir, "documents").withColumn("content", content), "doc_id", "content")


def _id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("image_id", "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))


def _coefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and coef: the vectors as 64 whole coefficients."""
    coef = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("int"))
    return B.once(_read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", "label", "embedding"), coef=coef).drop("embedding")


def _quant() -> list[int]:
    """QUANT_LUMA in zig-zag order."""
    out = [0] * 64
    for p, k in enumerate(blocks.ZIGZAG):
        out[k] = encode.QUANT_LUMA[p]
    return out


def _array(values: list[int]):
    return F.array(*map(F.lit, values))


def frame_magic(spark, sf_dir):
    return _id(_framed(spark, sf_dir)).select("doc_id", has_magic().alias("is_image"), "length", F.md5("content").alias("digest"))


def marker_scan(spark, sf_dir):
    return _id(segments.scan_markers(_framed(spark, sf_dir)))


def marker_groups(spark, sf_dir):
    found = _id(segments.scan_markers(_framed(spark, sf_dir)))
    return found.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def marker_universe(spark, sf_dir):
    return M.markers(spark)


def coding_processes(spark, sf_dir):
    return M.processes(spark)


def segment_payload(spark, sf_dir):
    found = segments.of_code(segments.segments(segments.parse(_framed(spark, sf_dir))), 0xFE)
    return _id(found).select("doc_id", "seq", "off", "len", F.md5("payload").alias("digest"))


def bit_expand(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").where("octet_length(text) > 0")
    each = docs.select("doc_id", F.posexplode(F.split(B.latin(F.encode("text", "UTF-8")), "")).alias("i", "c"))
    return each.select("doc_id", "i", F.lpad(F.bin(F.ascii("c")), 8, "0").alias("bits"))


def _raw(spark, sf_dir):
    at = lambda v, k: F.when(k % 7 == 0, 255).when(k % 7 == 1, 0).otherwise(F.pmod(F.floor(F.abs(v.cast("double")) * 255), F.lit(256))).cast("int")
    return _read(spark, sf_dir, "embeddings").select("vec_id", B.from_values(F.transform("embedding", at)).alias("raw"))


def byte_stuff(spark, sf_dir):
    return _raw(spark, sf_dir).select("vec_id", F.hex(B.stuff(F.col("raw"))).alias("stuffed"))


def byte_destuff(spark, sf_dir):
    return _raw(spark, sf_dir).select("vec_id", F.hex(B.destuff(F.col("raw"))).alias("destuffed"), F.hex(B.destuff(B.stuff(F.col("raw")))).alias("round_trip"))


def bit_stream(spark, sf_dir):
    return _raw(spark, sf_dir).select("vec_id", F.array_join(B.bits(F.col("raw")), "").alias("bits"))


def nibble_split(spark, sf_dir):
    x = F.pmod(F.col("p_size"), F.lit(256))
    return _read(spark, sf_dir, "part").select("p_partkey", B.high_nibble(x).alias("hi"), B.low_nibble(x).alias("lo"))


def _annex_k(spark):
    rows = [("k", 0, 0, *encode.DC_LUMA), ("k", 0, 1, *encode.DC_CHROMA)]
    return spark.createDataFrame(rows, "image_id string, class int, dest int, counts array<int>, symbols array<int>")


def code_lengths(spark, sf_dir):
    return huffman.code_lengths(_annex_k(spark))


def canonical_codes(spark, sf_dir):
    return huffman.canonical_codes(huffman.code_lengths(_annex_k(spark))).select("dest", "sym", "len", "code", huffman.code_text().alias("bits"))


def _stream(spark):
    return segments.parse(spark.createDataFrame([("stream", bytearray(STREAM), len(STREAM))], "image_id string, content binary, length long"))


def stream_segments(spark, sf_dir):
    return segments.segments(_stream(spark)).select("seq", F.hex("code").alias("code"), "off", "len")


def first_segments(spark, sf_dir):
    return _id(segments.first_only(segments.segments(segments.parse(_pieces(spark, sf_dir))))).select("doc_id", "seq", F.hex("code").alias("code"), "off", "len")


def segment_groups(spark, sf_dir):
    found = _id(segments.groups(segments.segments(segments.parse(_pieces(spark, sf_dir)))))
    places = F.array_join(F.transform("segments", lambda s: F.concat_ws("+", s["off"], s["len"])), ",")
    return found.select("doc_id", F.hex("code").alias("code"), F.size("segments").alias("n"), F.md5(places).alias("places"))


def marker_process(spark, sf_dir):
    return M.markers(spark).select("code", M.process(F.col("code")).alias("p")).select("code", "p.process", "p.coding")


def _tables(spark, sf_dir, code, size, one):
    """p_partkey and a stream with one segment of 1 to 16 tables, each `one` of its number in hexadecimal."""
    rows = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    body = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 16).cast("int")), one), "")
    length = F.lpad(F.hex((F.col("p_partkey") % 16 + 1) * size + 2), 4, "0")
    rows = B.once(rows, content=F.unhex(F.concat(F.lit(f"FFD8FF{code}"), length, body, F.lit("FFD9"))))
    return segments.segments(segments.parse(images_from(rows, "p_partkey", "content")))


def many_quant_tables(spark, sf_dir):
    value = lambda t, k: F.lpad(F.hex((F.col("p_size") + t * 7 + k) % 255 + 1), 2, "0")
    one = lambda t: F.concat(F.lpad(F.hex(t), 2, "0"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: value(t, k)), ""))
    found = headers.quant_tables(_tables(spark, sf_dir, "DB", 65, one))
    weighted = F.aggregate(F.transform("q", lambda q, k: q * (k + 1)), F.lit(0), lambda a, x: a + x)
    return found.select(F.col("image_id").cast("long").alias("p_partkey"), "tq", "pq", F.size("q").alias("n"), weighted.alias("weighted"))


def many_huffman_tables(spark, sf_dir):
    """Tables of class t mod 2 and destination t / 2, with three codes of t + 1 bits."""
    counts = lambda t: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when(k == t, "03").otherwise("00")), "")
    symbol = lambda t, k: F.lpad(F.hex((F.col("p_size") + t + k) % 256), 2, "0")
    one = lambda t: F.concat(F.hex(t % 2), F.hex((t / 2).cast("int")), counts(t), *(symbol(t, k) for k in range(3)))
    found = headers.huffman_tables(_tables(spark, sf_dir, "C4", 20, one))
    return found.select(F.col("image_id").cast("long").alias("p_partkey"), "class", "dest", F.array_join("counts", " ").alias("counts"), F.array_join("symbols", " ").alias("symbols"))


def huffman_lookup(spark, sf_dir):
    """For each vector as a scan component the last DC and AC table before its scan."""
    label = F.col("label")
    parts = _read(spark, sf_dir, "embeddings").select(F.lit("e").alias("image_id"), F.pmod(label, F.lit(7)).alias("seq"), F.col("vec_id").cast("int").alias("pos"), label.alias("id"), F.pmod(label, F.lit(3)).alias("td"), F.pmod(F.floor(label / 3).cast("int"), F.lit(3)).alias("ta"))
    rows = [("e", seq, kind, dest, [seq], [10 * kind + dest]) for seq, kind, dest in ((0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 0, 0), (4, 1, 1), (5, 1, 0))]
    tables = spark.createDataFrame(rows, "image_id string, seq int, class int, dest int, counts array<int>, symbols array<int>")
    found = headers.huffman_lookup(parts, tables)
    return found.select("seq", F.col("pos").alias("vec_id"), "id", "class", "dest", F.get("counts", F.lit(0)).alias("table_seq"), F.get("symbols", F.lit(0)).alias("symbol"), "error")


def frame_header(spark, sf_dir):
    segs = segments.segments(_stream(spark))
    parts = headers.frame_components(segs)
    return headers.frames(segs).join(parts, "image_id").select("precision", "height", "width", "pos", "id", "h", "v", "tq")


def scan_header(spark, sf_dir):
    segs = segments.segments(_stream(spark))
    return headers.scans(segs).join(headers.scan_components(segs), ["image_id", "seq"]).select("n", "ss", "se", "ah", "al", "pos", "id", "td", "ta")


def quant_table(spark, sf_dir):
    return headers.quant_tables(segments.segments(_stream(spark))).select("tq", "pq", F.posexplode("q").alias("k", "q"))


def table_counts(spark, sf_dir):
    return validate.table_counts(headers.huffman_tables(segments.segments(_stream(spark)))).drop("image_id")


def all_eight_bit(spark, sf_dir):
    return validate.all_eight_bit(headers.quant_tables(segments.segments(_stream(spark)))).drop("image_id")


def scan_data(spark, sf_dir):
    data = _stream(spark).select(F.explode(F.filter("segs", lambda s: s["code"] == M.SOS)).alias("s")).select("s.data")
    return data.select(F.hex("data").alias("stuffed"), F.hex(B.destuff(F.col("data"))).alias("destuffed"))


def quant_lookup(spark, sf_dir):
    parts = _read(spark, sf_dir, "embeddings").select(F.lit("e").alias("image_id"), "vec_id", F.pmod("label", F.lit(4)).alias("tq"))
    tables = spark.createDataFrame([("e", 1, 0, [16, 11]), ("e", 2, 1, [17, 18]), ("e", 3, 2, [3, 4]), ("e", 4, 1, [99, 98])], "image_id string, seq int, tq int, q array<int>")
    return headers.quant_lookup(parts, tables).select("vec_id", "tq", F.get("q", F.lit(0)).alias("q0"), "error")


def dezigzag(spark, sf_dir):
    return _coefs(spark, sf_dir).select("vec_id", F.posexplode(blocks.dezigzag(F.col("coef"))).alias("p", "c"))


def _ready(spark, sf_dir):
    ready = B.once(_coefs(spark, sf_dir).select("vec_id", "coef"), coef=blocks.dequantize(F.col("coef"), _array(_quant())))
    return B.once(ready, coef=blocks.dezigzag(F.col("coef")))


def dequantize(spark, sf_dir):
    return _ready(spark, sf_dir).select("vec_id", F.posexplode("coef").alias("p", "c"))


def idct(spark, sf_dir):
    long = dequantize(spark, sf_dir).withColumnRenamed("p", "k")
    return blocks.idct_join(long, ["vec_id"]).select("vec_id", "p", F.round("s", 3).alias("s"))


def level_shift(spark, sf_dir):
    shot = blocks.idct(_ready(spark, sf_dir)).select("vec_id", F.posexplode(blocks.level_shift(F.col("px"))).alias("p", "s"))
    return shot.select("vec_id", "p", F.round("s", 3).alias("s"))


def _triple(spark, sf_dir):
    at = lambda k: F.pmod(F.floor(F.abs(F.get("embedding", F.lit(k)).cast("double")) * 1000), F.lit(256)).cast("int")
    return _read(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))


def ycbcr_to_rgb(spark, sf_dir):
    rows = _triple(spark, sf_dir).withColumn("x", P.ycbcr_to_rgb(F.col("a"), F.col("b"), F.col("c")))
    return rows.select("vec_id", *(F.round(f"x.{k}", 6).alias(k) for k in "rgb"), *(P.to_sample(F.col(f"x.{k}")).alias(f"{k}8") for k in "rgb"))


def rgb_to_gray(spark, sf_dir):
    return _triple(spark, sf_dir).select("vec_id", P.rgb_to_gray(F.col("a"), F.col("b"), F.col("c")).alias("gray"))


def rgba_planes(spark, sf_dir):
    values = F.transform("embedding", lambda v: F.pmod(F.floor(F.abs(v.cast("double")) * 1000), F.lit(256)).cast("int"))
    rows = _read(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", P.rgba_planes(values, F.lit(16)).alias("p"), P.gray_rgba(values, F.lit(16)).alias("g"))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("p.r", "p.g", "p.b")).alias("i", "x"), "g").select("vec_id", "i", "x.r", "x.g", "x.b", F.get("g", F.col("i") * 4).alias("gray"))


def _wide(c, k):
    """A coefficient in the baseline's range, with runs of twenty zeros."""
    return F.when(k == 0, c % 1000).when(F.floor(k / 20) % 2 == 1, F.lit(0)).otherwise(F.greatest(F.least(c, F.lit(1023)), F.lit(-1023)))


def _dealt(df):
    """df over all tasks: a small table is one file, and encoding its rows takes far longer than reading them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vec_id")


def _encoded(spark, sf_dir):
    rows = _dealt(_coefs(spark, sf_dir)).select("vec_id", F.transform("coef", _wide).alias("coef"))
    return encode.encode_blocks(rows, "vec_id", "coef", _quant())


def decode_image(spark, sf_dir):
    shot = decode.decode_images(_encoded(spark, sf_dir))
    return shot.select(F.col("image_id").cast("long").alias("vec_id"), "y", "x", F.col("r").alias("gray"))


def image_errors(spark, sf_dir):
    """Encoded blocks, whole or damaged by vec_id modulo 4: no magic, cut in the header, cut in the scan, whole."""
    cut = F.col("image_id").cast("long") % 4
    content = F.when(cut == 0, F.substring(F.col("content"), 2, 1 << 20)).when(cut == 1, F.substring(F.col("content"), 1, 60)).when(cut == 2, F.concat(F.substring(F.col("content"), 1, 50), F.expr("X'FFFF00'"))).otherwise(F.col("content"))
    found = decode.image_errors(_encoded(spark, sf_dir).withColumn("content", content))
    return found.select(F.col("image_id").cast("long").alias("vec_id"), "stage", "code")


def header_errors(spark, sf_dir):
    """Encoded blocks with one byte changed by vec_id modulo 9, in the frame, the scan header or a marker."""
    # Fixed places of encode.gray_image: the frame's marker at 71, the scan's at 300.
    changes = [(72, "C2"), (72, "C1"), (75, "0C"), (80, "04"), (82, "51"), (301, "E1"), (305, "09"), (306, "11"), (77, "00")]
    kind = F.col("image_id").cast("long") % len(changes)
    content = F.col("content")
    for k, (at, byte) in enumerate(changes):
        content = F.when(kind == k, F.overlay(F.col("content"), F.expr(f"X'{byte}'"), at + 1)).otherwise(content)
    found = decode.image_errors(_encoded(spark, sf_dir).withColumn("content", content))
    return found.select(F.col("image_id").cast("long").alias("vec_id"), "stage", "code")


def _many_blocks(spark, sf_dir, n):
    """vec_id and n blocks of coefficients, each from another place of the vector on."""
    turned = lambda b: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda z: F.get("coef", (z + b * 5) % 64))
    narrow = lambda c, z: F.when(z == 0, c % 60).when(c % 3 == 0, F.lit(0)).otherwise(c % 24)
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.transform(turned(b), narrow))
    return _dealt(_coefs(spark, sf_dir)).select("vec_id", each.alias("blocks"))


def colour_image(spark, sf_dir):
    """Images of 32 by 16 pixels, chroma halved both ways, a restart marker between their two MCUs."""
    quant, halved = _quant(), [(2, 2), (1, 1), (1, 1)]
    rows = encode.encode_rows(_many_blocks(spark, sf_dir, 12), "vec_id", "blocks", lambda b: [encode.color_image(b, 32, 16, quant, halved, 1)], "content binary")
    shot = decode.grayscale(decode.decode_images(rows))
    return shot.select(F.col("image_id").cast("long").alias("vec_id"), "y", "x", "r", "g", "b", "gray")


def _separate(spark, sf_dir):
    """Images of three scans: by vec_id modulo 5 whole, cut after the first or second scan, ended after the first, cut within the third."""
    quant = _quant()
    rows = encode.encode_rows(_many_blocks(spark, sf_dir, 3), "vec_id", "blocks", lambda b: encode.separate_scans([[x] for x in b], 8, 8, quant), "head binary, a binary, b binary, c binary")
    kind, end = F.col("image_id").cast("long") % 5, F.expr("X'FFD9'")
    content = (
        F.when(kind == 0, F.concat("head", "a", "b", "c", end)).when(kind == 1, F.concat("head", "a")).when(kind == 2, F.concat("head", "a", "b"))
        .when(kind == 3, F.concat("head", "a", end)).otherwise(F.concat("head", "a", "b", F.substring("c", 1, 11)))
    )
    return rows.select("image_id", content.alias("content"))


def separate_scans(spark, sf_dir):
    shot = decode.decode_images(_separate(spark, sf_dir))
    return shot.select(F.col("image_id").cast("long").alias("vec_id"), "y", "x", "r", "g", "b")


def scan_errors(spark, sf_dir):
    return decode.image_errors(_separate(spark, sf_dir)).select(F.col("image_id").cast("long").alias("vec_id"), "stage", "code")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        frame_magic, marker_scan, marker_groups, marker_universe, coding_processes, segment_payload, bit_expand, bit_stream, byte_stuff, byte_destuff, nibble_split, code_lengths, canonical_codes, stream_segments, first_segments,
        frame_header, scan_header, quant_table, table_counts, all_eight_bit, scan_data, quant_lookup, dezigzag, dequantize, idct, level_shift, ycbcr_to_rgb, rgb_to_gray, rgba_planes, decode_image, image_errors,
        segment_groups, marker_process, many_quant_tables, many_huffman_tables, huffman_lookup, header_errors, colour_image, separate_scans, scan_errors,
    )
}

_TEXTS = "texts AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::INT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents)"
_FRAMED = f"""{_TEXTS}, parts AS (SELECT doc_id, n, k.k::INT AS k, substr(h, k.k * {2 * COMMENT} + 1, {2 * COMMENT}) AS part FROM texts, unnest(range(greatest((n + {COMMENT - 1}) // {COMMENT}, 1))) AS k(k)),
    framed AS (SELECT doc_id, 'FFD8' || string_agg('FFFE' || printf('%04X', len(part) // 2 + 2) || part, '' ORDER BY k) || 'FFD9' AS h FROM parts GROUP BY doc_id)"""
#: A stream's bytes are split at FF, as on the Spark side, so the work grows with its length.
_PAIRS = f"""{_FRAMED}, cut AS (SELECT doc_id, string_split(regexp_replace(h, '(..)', '\\1 ', 'g'), 'FF ') AS c FROM framed),
    runs AS (SELECT doc_id, unnest(c) AS run, generate_subscripts(c, 1) AS k FROM cut),
    placed AS (SELECT doc_id, run, k, (sum(len(run) // 3 + 1) OVER (PARTITION BY doc_id ORDER BY k) - len(run) // 3 - 2)::INT AS pos FROM runs),
    pairs AS (SELECT doc_id, pos, ('0x' || substr(run, 1, 2))::INT AS code FROM placed WHERE k > 1 AND run <> '' AND NOT starts_with(run, '00'))"""
_PIECES = f"""{_TEXTS}, sized AS (SELECT *, greatest((n + 2999) // 3000, 16) AS size FROM texts), piece AS (SELECT doc_id, k.k::INT AS seq, (['FE', 'E1', 'DB'])[k.k % 3 + 1] AS code, (6 + k.k * (size + 4))::INT AS off, least(size, n - k.k * size)::INT AS len
        FROM sized, unnest(range(greatest((n + size - 1) // size, 1))) AS k(k)),
    seg AS (SELECT * FROM piece UNION ALL SELECT doc_id, count(*)::INT, 'D9', (max(off + len) + 2)::INT, 0 FROM piece GROUP BY doc_id)"""
_ZIGZAG = """zz AS (SELECT p, row_number() OVER (ORDER BY p // 8 + p % 8, CASE WHEN (p // 8 + p % 8) % 2 = 1 THEN p // 8 ELSE p % 8 END) - 1 AS z FROM range(64) AS r(p))"""
_COEFS = f"""{_ZIGZAG}, coefs AS (SELECT vec_id, p::INT AS p, z, round(embedding[z + 1]::DOUBLE * 1000)::INT AS c FROM embeddings, zz WHERE len(embedding) = 64)"""
_QUANT = f"""quant AS (SELECT i.i AS p, ({encode.QUANT_LUMA})[i.i + 1] AS q FROM range(64) AS i(i))"""
_BASIS = """basis AS (SELECT p.p, k.k, (CASE WHEN k.k % 8 = 0 THEN sqrt(0.5) ELSE 1 END) * (CASE WHEN k.k // 8 = 0 THEN sqrt(0.5) ELSE 1 END) / 4
    * cos((2 * (p.p % 8) + 1) * (k.k % 8) * pi() / 16) * cos((2 * (p.p // 8) + 1) * (k.k // 8) * pi() / 16) AS w FROM range(64) AS p(p), range(64) AS k(k))"""
_SAMPLES = f"""{_COEFS}, {_QUANT}, {_BASIS}, sums AS (SELECT vec_id, basis.p::INT AS p, sum(c * q * w) AS s FROM coefs JOIN quant USING (p) JOIN basis ON basis.k = coefs.p GROUP BY ALL)"""
_BITS = "concat({0})".format(", ".join(f"((v >> {k}) & 1)" for k in range(7, -1, -1)))
_RAW = """raw AS (SELECT vec_id, string_agg(printf('%02X', CASE WHEN k % 7 = 0 THEN 255 WHEN k % 7 = 1 THEN 0 ELSE floor(abs(embedding[k + 1]::DOUBLE) * 255)::INT % 256 END), ' ' ORDER BY k) || ' ' AS h
    FROM embeddings, range(64) AS r(k) WHERE k < len(embedding) GROUP BY vec_id)"""
_TRIPLE = "t AS (SELECT vec_id, {0} FROM embeddings)".format(", ".join(f"floor(abs(embedding[{k + 1}]::DOUBLE) * 1000)::INT % 256 AS {n}" for k, n in enumerate("abc")))
_ANNEX_K = """n(dest, counts) AS (VALUES (0, [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), (1, [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0])),
    lengths AS (SELECT dest, l.l::INT AS len, (row_number() OVER (PARTITION BY dest ORDER BY l.l, r.r) - 1)::INT AS sym FROM n, range(1, 17) AS l(l), unnest(range(0, counts[l.l])) AS r(r))"""
_CODES = """CASE WHEN c = 1 THEN 'TEM' WHEN c < 192 THEN 'RES' || c WHEN c = 196 THEN 'DHT' WHEN c = 200 THEN 'JPG' WHEN c = 204 THEN 'DAC' WHEN c < 208 THEN 'SOF' || (c - 192) WHEN c < 216 THEN 'RST' || (c - 208)
    WHEN c < 224 THEN (['SOI', 'EOI', 'SOS', 'DQT', 'DNL', 'DRI', 'DHP', 'EXP'])[c - 215] WHEN c < 240 THEN 'APP' || printf('%X', c - 224) WHEN c < 254 THEN 'JPG' || (c - 240) ELSE 'COM' END"""
_MANY = """value AS (SELECT vec_id, b.b, z.z, round(embedding[(z.z + b.b * 5) % 64 + 1]::DOUBLE * 1000)::INT AS c FROM embeddings, range({n}) AS b(b), range(64) AS z(z) WHERE len(embedding) = 64 AND {which}),
    small AS (SELECT vec_id, b, zz.p, CASE WHEN z = 0 THEN c % 60 WHEN c % 3 = 0 THEN 0 ELSE c % 24 END AS c FROM value JOIN zz USING (z)),
    sample AS (SELECT vec_id, b, basis.p AS p, least(greatest(floor(sum(c * q * w) + 128.5), 0), 255) AS s FROM small JOIN quant USING (p) JOIN basis ON basis.k = small.p GROUP BY ALL)"""
_RGB = """least(greatest(floor(y.s + 1.402::DOUBLE * (r.s - 128) + 0.5), 0), 255)::INT AS r, least(greatest(floor(y.s - 0.344136::DOUBLE * (b.s - 128) - 0.714136::DOUBLE * (r.s - 128) + 0.5), 0), 255)::INT AS g,
    least(greatest(floor(y.s + 1.772::DOUBLE * (b.s - 128) + 0.5), 0), 255)::INT AS b"""
_SEGMENTS = """seg(seq, code, off, len) AS (VALUES (0, 'E0', 6, 14), (1, 'DB', 24, 65), (2, 'DB', 93, 65), (3, 'C0', 162, 15), (4, 'C4', 181, 29), (5, 'C4', 214, 179), (6, 'C4', 397, 29), (7, 'C4', 430, 179), (8, 'DA', 613, 10), (9, 'D9', 636, 0))"""

ORACLE_SQL: dict[str, str] = {
    "frame_magic": f"WITH {_FRAMED} SELECT doc_id, substr(h, 1, 4) = 'FFD8' AS is_image, (len(h) // 2)::BIGINT AS length, md5(unhex(h)) AS digest FROM framed",
    "marker_scan": f"WITH {_PAIRS} SELECT doc_id, pos, code FROM pairs",
    "marker_groups": f"WITH {_PAIRS} SELECT doc_id, code, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM pairs GROUP BY ALL",
    "marker_universe": f"SELECT c::INT AS code, {_CODES} AS name, NOT (c = 1 OR c BETWEEN 208 AND 217) AS is_segment, c NOT IN (196, 204, 219, 223) AS is_singleton FROM range(1, 255) AS r(c)",
    "coding_processes": "SELECT * FROM (VALUES ('baseline', true, false, true, false, true, false, 2, 2), ('extended_sequential', true, true, true, true, true, true, 4, 4)) AS t(process, eight_bit, sixteen_bit, sequential, progressive, huffman, arithmetic, ac_tables, dc_tables)",
    "segment_payload": f"WITH {_FRAMED} SELECT doc_id, k AS seq, (6 + k * {COMMENT + 4})::INT AS off, (len(part) // 2)::INT AS len, md5(unhex(part)) AS digest FROM parts",
    "bit_expand": f"""WITH {_TEXTS}, bytes AS (SELECT doc_id, regexp_extract_all(h, '..') AS x FROM texts), b AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, ('0x' || unnest(x))::INT AS v FROM bytes)
        SELECT doc_id, i::INT AS i, {_BITS} AS bits FROM b""",
    "byte_stuff": f"WITH {_RAW} SELECT vec_id, replace(replace(h, 'FF ', 'FF 00 '), ' ', '') AS stuffed FROM raw",
    "byte_destuff": f"WITH {_RAW} SELECT vec_id, replace(replace(h, 'FF 00 ', 'FF '), ' ', '') AS destuffed, replace(h, ' ', '') AS round_trip FROM raw",
    "bit_stream": f"WITH {_RAW} SELECT vec_id, unhex(replace(h, ' ', ''))::BIT::VARCHAR AS bits FROM raw",
    "nibble_split": "SELECT p_partkey, ((p_size % 256) >> 4)::INT AS hi, ((p_size % 256) & 15)::INT AS lo FROM part",
    "code_lengths": f"WITH {_ANNEX_K} SELECT 'k' AS image_id, 0 AS class, dest, sym AS ord, sym, len FROM lengths",
    "canonical_codes": f"""WITH {_ANNEX_K}, used AS (SELECT *, coalesce(sum(1::BIGINT << (16 - len)) OVER (PARTITION BY dest ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS u FROM lengths)
        SELECT dest, sym, len, u >> (16 - len) AS code, lpad(bin(u >> (16 - len)), len, '0') AS bits FROM used""",
    "stream_segments": f"WITH {_SEGMENTS} SELECT * FROM seg",
    "first_segments": f"WITH {_PIECES} SELECT * FROM seg QUALIFY code = 'DB' OR row_number() OVER (PARTITION BY doc_id, code ORDER BY seq) = 1",
    "segment_groups": f"WITH {_PIECES} SELECT doc_id, code, count(*)::INT AS n, md5(string_agg(off || '+' || len, ',' ORDER BY seq)) AS places FROM seg GROUP BY doc_id, code",
    "marker_process": "SELECT c::INT AS code, CASE c WHEN 192 THEN 'baseline' WHEN 193 THEN 'extended_sequential' END AS process, CASE WHEN c IN (192, 193) THEN 'huffman' END AS coding FROM range(1, 255) AS r(c)",
    "many_quant_tables": """SELECT p_partkey, (t.t % 16)::INT AS tq, 0 AS pq, 64 AS n, sum(((p_size + t.t * 7 + k.k) % 255 + 1) * (k.k + 1))::INT AS weighted
        FROM part, unnest(range(p_partkey % 16 + 1)) AS t(t), range(64) AS k(k) GROUP BY p_partkey, t.t""",
    "many_huffman_tables": """SELECT p_partkey, (t.t % 2)::INT AS class, (t.t // 2)::INT AS dest, array_to_string([CASE WHEN k = t.t THEN 3 ELSE 0 END for k in range(16)], ' ') AS counts,
        array_to_string([(p_size + t.t + k) % 256 for k in range(3)], ' ') AS symbols FROM part, unnest(range(p_partkey % 16 + 1)) AS t(t)""",
    "huffman_lookup": """WITH t(table_seq, class, dest, symbol) AS (VALUES (0, 0, 0, 0), (1, 0, 1, 1), (2, 1, 0, 10), (3, 0, 0, 0), (4, 1, 1, 11), (5, 1, 0, 10)),
        c AS (SELECT label % 7 AS seq, vec_id::INT AS vec_id, label AS id, k.k AS class, CASE k.k WHEN 0 THEN label % 3 ELSE (label // 3) % 3 END AS dest FROM embeddings, (VALUES (0), (1)) AS k(k))
        SELECT seq, vec_id, id, class, dest, max(table_seq) AS table_seq, max(symbol) AS symbol, CASE WHEN max(table_seq) IS NULL THEN 'missing_huffman_table' END AS error
        FROM c LEFT JOIN t USING (class, dest) WHERE table_seq IS NULL OR table_seq < seq GROUP BY ALL
        UNION ALL SELECT seq, vec_id, id, class, dest, NULL, NULL, 'missing_huffman_table' FROM c WHERE EXISTS (FROM t WHERE t.class = c.class AND t.dest = c.dest) AND NOT EXISTS (FROM t WHERE t.class = c.class AND t.dest = c.dest AND t.table_seq < c.seq)""",
    "header_errors": """WITH e AS (SELECT unnest(['unsupported_process', 'unsupported_process', 'unsupported_precision', 'unsupported_components', 'bad_sampling', 'no_marker', 'scan_component_not_in_frame', 'missing_huffman_table', 'bad_size']) AS code, unnest(range(9)) AS k)
        SELECT vec_id, CASE WHEN code = 'missing_huffman_table' THEN 'scan' ELSE 'header' END AS stage, code FROM embeddings JOIN e ON k = vec_id % 9 WHERE len(embedding) = 64""",
    "colour_image": f"""WITH {_ZIGZAG}, {_QUANT}, {_BASIS}, {_MANY.format(n=12, which=True)}, spot AS (SELECT y.y, x.x, x.x // 16 * 6 + y.y // 8 * 2 + x.x % 16 // 8 AS luma, x.x // 16 * 6 + 4 AS chroma, y.y % 8 * 8 + x.x % 8 AS p, y.y // 2 * 8 + x.x % 16 // 2 AS half FROM range(16) AS y(y), range(32) AS x(x)),
        shot AS (SELECT y.vec_id, spot.y::INT AS y, spot.x::INT AS x, {_RGB} FROM spot JOIN sample y ON y.b = luma AND y.p = spot.p JOIN sample b ON b.vec_id = y.vec_id AND b.b = chroma AND b.p = half JOIN sample r ON r.vec_id = y.vec_id AND r.b = chroma + 1 AND r.p = half)
        SELECT *, trunc(r::FLOAT * 0.29891::FLOAT + g::FLOAT * 0.58661::FLOAT + b::FLOAT * 0.11448::FLOAT)::INT AS gray FROM shot""",
    "separate_scans": f"""WITH {_ZIGZAG}, {_QUANT}, {_BASIS}, {_MANY.format(n=3, which="vec_id % 5 = 0")}
        SELECT y.vec_id, (y.p // 8)::INT AS y, (y.p % 8)::INT AS x, {_RGB} FROM sample y JOIN sample b ON b.vec_id = y.vec_id AND b.p = y.p JOIN sample r ON r.vec_id = y.vec_id AND r.p = y.p WHERE y.b = 0 AND b.b = 1 AND r.b = 2""",
    "scan_errors": "SELECT vec_id, CASE vec_id % 5 WHEN 4 THEN 'scan' ELSE 'header' END AS stage, CASE vec_id % 5 WHEN 3 THEN 'missing_scan' WHEN 4 THEN 'truncated_scan' ELSE 'truncated' END AS code FROM embeddings WHERE vec_id % 5 > 0 AND len(embedding) = 64",
    "frame_header": "SELECT 8 AS precision, 2 AS height, 6 AS width, * FROM (VALUES (0, 1, 2, 2, 0), (1, 2, 1, 1, 1), (2, 3, 1, 1, 1)) AS t(pos, id, h, v, tq)",
    "scan_header": "SELECT 3 AS n, 0 AS ss, 63 AS se, 0 AS ah, 0 AS al, * FROM (VALUES (0, 1, 0, 0), (1, 2, 1, 1), (2, 3, 1, 1)) AS t(pos, id, td, ta)",
    "quant_table": "SELECT t.t::INT AS tq, 0 AS pq, k::INT AS k, (CASE WHEN t.t = 0 THEN k + 1 ELSE 64 - k END)::INT AS q FROM range(2) AS t(t), range(64) AS r(k)",
    "table_counts": "SELECT 2::BIGINT AS ac, 2::BIGINT AS dc, true AS baseline_pair",
    "all_eight_bit": "SELECT true AS all_eight_bit",
    "scan_data": "SELECT 'FF0000FF00FF0002046802' AS stuffed, 'FF00FFFF02046802' AS destuffed",
    "quant_lookup": """WITH q(tq, q0) AS (VALUES (0, 16), (1, 99), (2, 3)) SELECT vec_id, e.tq, q0, CASE WHEN q0 IS NULL THEN 'missing_quant_table' END AS error
        FROM (SELECT vec_id, label % 4 AS tq FROM embeddings) e LEFT JOIN q USING (tq)""",
    "dezigzag": f"WITH {_COEFS} SELECT vec_id, p, c FROM coefs",
    "dequantize": f"WITH {_COEFS}, {_QUANT} SELECT vec_id, p, (c * q)::INT AS c FROM coefs JOIN quant USING (p)",
    "idct": f"WITH {_SAMPLES} SELECT vec_id, p, round(s, 3) AS s FROM sums",
    "level_shift": f"WITH {_SAMPLES} SELECT vec_id, p, round(s + 128, 3) AS s FROM sums",
    "ycbcr_to_rgb": f"""WITH {_TRIPLE}, x AS (SELECT vec_id, a + 1.402::DOUBLE * (c - 128) AS r, a - 0.344136::DOUBLE * (b - 128) - 0.714136::DOUBLE * (c - 128) AS g, a + 1.772::DOUBLE * (b - 128) AS b FROM t)
        SELECT vec_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, {", ".join(f"least(greatest(floor({k} + 0.5), 0), 255)::INT AS {k}8" for k in "rgb")} FROM x""",
    "rgb_to_gray": f"WITH {_TRIPLE} SELECT vec_id, trunc(a::FLOAT * 0.29891::FLOAT + b::FLOAT * 0.58661::FLOAT + c::FLOAT * 0.11448::FLOAT)::INT AS gray FROM t",
    "rgba_planes": f"""WITH x AS (SELECT vec_id, i::INT AS i, {", ".join(f"floor(abs(embedding[4 * i + {k + 1}]::DOUBLE) * 1000)::INT % 256 AS {n}" for k, n in enumerate("rgb"))} FROM embeddings, range(16) AS t(i) WHERE len(embedding) = 64)
        SELECT vec_id, i, r, g, b, trunc(r::FLOAT * 0.29891::FLOAT + g::FLOAT * 0.58661::FLOAT + b::FLOAT * 0.11448::FLOAT)::INT AS gray FROM x""",
    "decode_image": f"""WITH {_COEFS}, {_QUANT}, {_BASIS}, small AS (SELECT vec_id, p, CASE WHEN z = 0 THEN c % 1000 WHEN z // 20 % 2 = 1 THEN 0 ELSE greatest(least(c, 1023), -1023) END AS c FROM coefs),
        sums AS (SELECT vec_id, basis.p AS p, sum(c * q * w) AS s FROM small JOIN quant USING (p) JOIN basis ON basis.k = small.p GROUP BY ALL)
        SELECT vec_id, (p // 8)::INT AS y, (p % 8)::INT AS x, least(greatest(floor(s + 128 + 0.5), 0), 255)::INT AS gray FROM sums""",
    "image_errors": """SELECT vec_id, 'header' AS stage, CASE vec_id % 4 WHEN 0 THEN 'no_start_of_image' WHEN 1 THEN 'truncated' ELSE 'truncated' END AS code FROM embeddings WHERE vec_id % 4 < 3 AND len(embedding) = 64""",
}
