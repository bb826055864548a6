import random

from pyspark.sql import functions as F

from blockloom.functions import bytes as B
from blockloom.functions import pixels as P


def rows(spark, values, *columns):
    df = spark.createDataFrame([(bytearray(v) if v is not None else None,) for v in values], "b binary")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_bits_of_bytes(spark):
    (bits,) = rows(spark, [bytes([4, 21, 69])], B.bits(F.col("b")))[0]
    assert "".join(map(str, bits)) == "000001000001010101000101"
    assert rows(spark, [b""], B.bits(F.col("b")), B.byte_values(F.col("b"))) == [([], [])]


def test_numbers_and_nibbles(spark):
    assert rows(spark, [bytes([0x12, 0xF0, 0xFF])], B.be16(F.col("b"), 1), B.byte_at(F.col("b"), 0), B.byte_at(F.col("b"), 3), B.high_nibble(B.byte_at(F.col("b"), 0)), B.low_nibble(B.byte_at(F.col("b"), 0))) == [(0xF0FF, 0x12, None, 1, 2)]


def test_destuff_undoes_stuff(spark):
    random.seed(5)
    values = [bytes(random.choice((0, 255, random.randrange(256))) for _ in range(random.randrange(200))) for _ in range(60)]
    values += [b"", b"\xff", b"\xff\x00", b"\x00\xff" * 64, b"a" * 63 + b"\xff\x00" + b"b" * 70]
    got = rows(spark, values, "b", B.stuff(F.col("b")), B.destuff(B.stuff(F.col("b"))), B.destuff(F.col("b")))
    for raw, stuffed, back, plain in got:
        assert bytes(back) == bytes(raw)
        assert bytes(stuffed) == bytes(raw).replace(b"\xff", b"\xff\x00")
        assert bytes(plain) == bytes(raw).replace(b"\xff\x00", b"\xff")


def test_reference_scan_data(spark):
    (data,) = rows(spark, [bytes.fromhex("FF0000FF00FF0002046802")], B.destuff(F.col("b")))[0]
    assert data == bytes.fromhex("FF00FFFF02046802")


def test_marker_positions(spark):
    random.seed(6)
    values = [bytes(random.choice((0, 255, 0xD8, 7)) for _ in range(n)) for n in range(60)] + [b"\xff", b"", b"\xff\xff\xd8"]
    for raw, found in rows(spark, values, "b", B.marker_positions(F.col("b"))):
        raw = bytes(raw)
        assert [(m.pos, m.code) for m in found] == [(i, raw[i + 1]) for i in range(len(raw) - 1) if raw[i] == 255 and raw[i + 1] not in (0, 255)]


def test_pixels(spark):
    df = spark.createDataFrame([(76, 85, 255), (255, 128, 128), (0, 0, 0)], "y int, b int, r int")
    x = P.ycbcr_to_rgb(F.col("y"), F.col("b"), F.col("r"))
    got = [tuple(r) for r in df.select(*(P.to_sample(x[k]) for k in "rgb")).collect()]
    assert got == [(254, 0, 0), (255, 255, 255), (0, 135, 0)]
    flat = spark.createDataFrame([([10, 20, 30, 1, 40, 50, 60, 2],)], "v array<int>")
    planes, gray = flat.select(P.rgba_planes(F.col("v"), F.lit(2)), P.gray_rgba(F.col("v"), F.lit(2))).first()
    assert (planes.r, planes.g, planes.b) == ([10, 40], [20, 50], [30, 60])
    assert gray == [18, 18, 18, 255, 48, 48, 48, 255]
