import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import blocks, encode, headers, huffman, segments
from blockloom.plans import decode
from blockloom.queries import STREAM
from blockloom.sources.images import read_images

SCHEMA = "image_id string, content binary, length long"


def images(spark, **contents):
    return spark.createDataFrame([(k, None if v is None else bytearray(v), None if v is None else len(v)) for k, v in contents.items()], SCHEMA)


def gray_blocks(n, seed=1):
    random.seed(seed)
    return [[random.randint(-60, 60) if k == 0 else random.choice((0, 0, 0, random.randint(-12, 12))) for k in range(64)] for _ in range(n)]


def expected(coefs, quant, width, height):
    n = np.arange(8)
    wave = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(0.5), 1) / 2
    across = -(-width // 8)
    out = np.zeros((-(-height // 8) * 8, across * 8))
    for k, block in enumerate(coefs):
        natural = np.array([block[z] * quant[z] for z in blocks.ZIGZAG]).reshape(8, 8)
        y, x = divmod(k, across)
        out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = wave @ natural @ wave.T
    return np.clip(np.floor(out + 128.5), 0, 255)[:height, :width]


def plane(rows, image_id, column="r"):
    own = [r for r in rows if r.image_id == image_id]
    out = np.full((max(r.y for r in own) + 1, max(r.x for r in own) + 1), -1)
    for r in own:
        out[r.y, r.x] = r[column]
    return out


def test_zigzag_is_a_permutation():
    assert sorted(blocks.ZIGZAG) == list(range(64))
    assert [blocks.ZIGZAG[i] for i in (0, 1, 8, 16, 9, 2, 63)] == [0, 1, 2, 3, 4, 5, 63]


def test_headers_of_the_stream(spark):
    segs = segments.segments(segments.parse(images(spark, s=STREAM)))
    frame = headers.frames(segs).first()
    assert (frame.precision, frame.height, frame.width) == (8, 2, 6)
    assert [tuple(r)[2:] for r in headers.frame_components(segs).orderBy("pos").collect()] == [(1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1)]
    tables = headers.huffman_tables(segs).orderBy("seq").collect()
    assert [(t["class"], t.dest) for t in tables] == [(0, 0), (1, 0), (0, 1), (1, 1)]
    found = {(r.id, r["class"]): r.error for r in headers.huffman_lookup(headers.scan_components(segs), headers.huffman_tables(segs)).collect()}
    assert len(found) == 6 and set(found.values()) == {None}
    lookup = headers.quant_lookup(headers.frame_components(segs), headers.quant_tables(segs)).collect()
    assert {r.id: r.q[0] for r in lookup} == {1: 1, 2: 64, 3: 64}


def test_several_tables_in_a_segment_and_the_last_wins(spark):
    both = bytes([0, *[3] * 64, 1, *[5] * 64])
    stream = b"\xff\xd8" + encode.segment(0xDB, both) + encode.segment(0xDB, bytes([0x10]) + b"\1\2" * 64) + b"\xff\xd9"
    segs = segments.segments(segments.parse(images(spark, s=stream)))
    tables = headers.quant_tables(segs)
    assert [(t.tq, t.pq, t.q[0]) for t in tables.orderBy("seq", "tq").collect()] == [(0, 0, 3), (1, 0, 5), (0, 1, 258)]
    parts = spark.createDataFrame([("s", 0, 0), ("s", 1, 1), ("s", 2, 2)], "image_id string, pos int, tq int")
    assert [(r.q and r.q[0], r.error) for r in headers.quant_lookup(parts, tables).orderBy("pos").collect()] == [(258, None), (5, None), (None, "missing_quant_table")]


def test_canonical_codes_are_prefix_free(spark):
    rows = [("i", 0, 0, *encode.DC_LUMA), ("i", 1, 0, *encode.AC_LUMA)]
    tables = spark.createDataFrame(rows, "image_id string, class int, dest int, counts array<int>, symbols array<int>")
    found = huffman.canonical_codes(huffman.code_lengths(tables)).withColumn("bits", huffman.code_text()).collect()
    for kind, table in ((0, encode.DC_LUMA), (1, encode.AC_LUMA)):
        own = {r.sym: r.bits for r in found if r["class"] == kind}
        assert own == encode.codes(table)
        ordered = sorted(own.values())
        assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:], strict=False))


def test_both_transforms_agree(spark):
    coefs = gray_blocks(20)
    df = spark.createDataFrame(list(enumerate(coefs)), "id int, coef array<int>")
    long = df.select("id", F.posexplode("coef").alias("k", "c"))
    joined = {(r.id, r.p): r.s for r in blocks.idct_join(long, ["id"]).collect()}
    for r in blocks.idct(df).collect():
        assert np.allclose(r.px, [joined[r.id, p] for p in range(64)])


@pytest.mark.parametrize("restart", [0, 1, 4])
def test_gray_round_trip(spark, restart):
    quant, coefs = [1 + k // 8 for k in range(64)], gray_blocks(3 * 4)
    shot = decode.decode_images(images(spark, g=encode.gray_image(coefs, 29, 18, quant, restart))).collect()
    assert np.array_equal(plane(shot, "g"), expected(coefs, quant, 29, 18))
    assert all(r.r == r.g == r.b for r in shot)


def color_image(coefs, quant, width, height):
    """Three scans of one component each."""
    dht = lambda kind, t: encode.segment(0xC4, bytes([kind, *t[0], *t[1]]))
    parts = [b"\xff\xd8", encode.segment(0xDB, bytes([0, *quant])), encode.segment(0xC0, bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])), dht(0, encode.DC_LUMA), dht(0x10, encode.AC_LUMA)]
    for k, own in enumerate(coefs):
        parts += [encode.segment(0xDA, bytes([1, k + 1, 0, 0, 63, 0])), encode.entropy(own)]
    return b"".join([*parts, b"\xff\xd9"])


def test_color_in_separate_scans(spark):
    quant = [1] * 64
    coefs = [gray_blocks(6, s) for s in (1, 2, 3)]
    shot = decode.decode_images(images(spark, c=color_image(coefs, quant, 20, 13))).collect()
    y, cb, cr = (expected(c, quant, 20, 13) for c in coefs)
    rgb = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    for name, want in zip("rgb", rgb, strict=True):
        assert np.array_equal(plane(shot, "c", name), np.clip(np.floor(want + 0.5), 0, 255))


def test_against_the_jvm(spark, tmp_path):
    jvm = spark._jvm
    kind = jvm.java.awt.image.BufferedImage
    for name, gray, width, height in (("gray", True, 50, 33), ("color", False, 40, 24)):
        shot = kind(width, height, kind.TYPE_BYTE_GRAY if gray else kind.TYPE_INT_RGB)
        for y in range(height):
            for x in range(width):
                v = int(128 + 60 * np.sin(x / 9) + 40 * np.cos(y / 7))
                shot.setRGB(x, y, v << 16 | v << 8 | v)
        jvm.javax.imageio.ImageIO.write(shot, "jpg", jvm.java.io.File(str(tmp_path / f"{name}.jpg")))
    rows = decode.decode_images(read_images(spark, str(tmp_path), "*.jpg")).collect()
    ref = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(ref) == 2
    for r in ref:
        theirs = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels).astype(int)[:, :, -1]
        ours = plane(rows, "file:" + r.origin.removeprefix("file:").replace("///", "/"))
        assert np.abs(ours - theirs).max() <= 2


def test_damaged_images_are_rows(spark):
    good = encode.gray_image(gray_blocks(4), 16, 16, [1] * 64)
    sos = good.index(b"\xff\xda")
    cases = {
        "null": (None, "no_start_of_image"), "empty": (b"", "no_start_of_image"), "magic": (b"\xff\xd8", "no_frame"), "text": (b"hello", "no_start_of_image"),
        "cut_header": (good[:100], "truncated"), "cut_scan": (good[: sos + 14], "truncated_scan"), "length": (b"\xff\xd8\xff\xe0\0\1", "bad_length"), "bytes": (b"\xff\xd8ab", "no_marker"),
        "no_frame": (b"\xff\xd8\xff\xd9", "no_frame"), "progressive": (good.replace(b"\xff\xc0", b"\xff\xc2"), "unsupported_process"), "deep": (good.replace(b"\xff\xc0\0\x0b\x08", b"\xff\xc0\0\x0b\x0c"), "unsupported_precision"),
        "no_quant": (good.replace(b"\xff\xdb", b"\xff\xe1"), "missing_quant_table"), "no_huffman": (good.replace(b"\xff\xc4", b"\xff\xe2"), "missing_huffman_table"), "no_scan": (good[:sos] + b"\xff\xd9", "no_scan"), "good": (good, None),
    }
    df = images(spark, **{k: v[0] for k, v in cases.items()})
    found = {r.image_id: r.code for r in decode.image_errors(df).collect()}
    assert found == {k: code for k, (_, code) in cases.items() if code}
    assert {r.image_id for r in decode.decode_images(df).select("image_id").distinct().collect()} == {"good"}
    assert decode.decode_images(df.limit(0)).count() == 0


def test_embedded_stream_is_not_scanned(spark):
    inner = encode.gray_image(gray_blocks(1, 9), 8, 8, [7] * 64)
    outer = encode.gray_image(gray_blocks(1), 8, 8, [1] * 64)
    whole = outer[:2] + encode.segment(0xE1, inner) + outer[2:]
    shot = decode.decode_images(images(spark, o=whole)).collect()
    assert np.array_equal(plane(shot, "o"), expected(gray_blocks(1), [1] * 64, 8, 8))
    raw = segments.scan_markers(images(spark, o=whole)).where("code = 216").count()
    assert raw == 2


def test_streams_of_many_segments(spark):
    good = encode.gray_image(gray_blocks(1), 8, 8, [1] * 64)
    many = {"segments": good[:2] + encode.segment(0xE1, b"x") * 1500 + good[2:], "fill": good[:2] + b"\xff" * 1500 + good[2:]}
    df = images(spark, **many)
    shot = decode.decode_images(df).collect()
    for name in many:
        assert np.array_equal(plane(shot, name), expected(gray_blocks(1), [1] * 64, 8, 8))
    assert decode.image_errors(df).count() == 0


def test_lanes_equal_single_intervals():
    rng = random.Random(8)
    tables = [huffman.Table(*encode.DC_LUMA), huffman.Table(*encode.AC_LUMA), huffman.Table(*encode.DC_CHROMA)]
    data, plans, units = [], [], []
    for k in range(300):
        comps = 1 + k % 3
        plan = [(c, tables[0], tables[1]) for c in range(comps)]
        n = rng.randrange(0, 6)
        own = encode.entropy(gray_blocks(n * comps, k), plan=tuple(range(comps))).replace(b"\xff\0", b"\xff")
        if k % 4 == 1:
            own = own[: rng.randrange(len(own) + 1)]
        if k % 4 == 2 and own:
            own = bytes(rng.randrange(256) for _ in own)
        if k % 50 == 3:
            own = b"\xff" * 40
        if k % 9 == 0:
            plan = [(c, tables[2], tables[1]) for c in range(comps)]
        data.append(own)
        plans.append(plan)
        units.append(n + (k % 7 == 0))

    def single(*own):
        try:
            return huffman.decode_interval(*own).tolist()
        except ValueError as e:
            return str(e)

    want = [single(d, p, u) for d, p, u in zip(data, plans, units, strict=True)]
    got = [str(x) if isinstance(x, ValueError) else x.tolist() for x in huffman.decode_lanes(data, plans, units)]
    assert got == want
    assert {x for x in want if isinstance(x, str)} == {"truncated_scan", "bad_code", "bad_run"}


def test_color_of_whole_mcus_with_restarts(spark):
    quant, factors = [1] * 64, [(2, 2), (1, 1), (1, 1)]
    coefs = gray_blocks(6 * 6, 5)
    for restart in (0, 1, 2):
        shot = decode.decode_images(images(spark, c=encode.color_image(coefs, 45, 30, quant, factors, restart))).collect()
        assert len(shot) == 45 * 30
        samples = [expected([c], quant, 8, 8) for c in coefs]
        for r in shot[::37]:
            unit, y, x = r.y // 16 * 3 + r.x // 16, r.y % 16, r.x % 16
            luma = samples[unit * 6 + y // 8 * 2 + x // 8][y % 8, x % 8]
            cb, cr = (samples[unit * 6 + k][y // 2, x // 2] - 128 for k in (4, 5))
            want = (luma + 1.402 * cr, luma - 0.344136 * cb - 0.714136 * cr, luma + 1.772 * cb)
            assert (r.r, r.g, r.b) == tuple(int(np.clip(np.floor(v + 0.5), 0, 255)) for v in want)


def test_no_exchange_for_whole_mcus(spark):
    df = images(spark, g=encode.gray_image(gray_blocks(4), 16, 16, [1] * 64))
    found = decode.intervals(decode.describe(df))
    plan = decode.whole_pixels(found)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and decode.whole_pixels(found).count() == 256


def test_missing_scans_give_no_pixels(spark):
    own = color_image([gray_blocks(6, s) for s in (1, 2, 3)], [1] * 64, 20, 13)
    starts = [i for i in range(len(own) - 1) if own[i : i + 2] == b"\xff\xda"]
    cases = {"one": own[: starts[1]], "two": own[: starts[2]], "ended": own[: starts[1]] + b"\xff\xd9", "within": own[: starts[2] + 14], "whole": own, "unended": own[:-2]}
    df = images(spark, **cases)
    assert {r.image_id: (r.stage, r.code) for r in decode.image_errors(df).collect()} == {"one": ("header", "truncated"), "two": ("header", "truncated"), "ended": ("header", "missing_scan"), "within": ("scan", "truncated_scan")}
    assert {r.image_id: r["count"] for r in decode.decode_images(df).groupBy("image_id").count().collect()} == {"whole": 260, "unended": 260}


def test_any_number_of_tables_in_a_segment(spark):
    quant = b"".join(bytes([t % 4, *[t + 1] * 64]) for t in range(16))
    huff = b"".join(bytes([t % 2 << 4 | t // 2, *encode.DC_LUMA[0], *encode.DC_LUMA[1]]) for t in range(16))
    segs = segments.segments(segments.parse(images(spark, s=b"\xff\xd8" + encode.segment(0xDB, quant) + encode.segment(0xC4, huff) + b"\xff\xd9")))
    assert [t.q[0] for t in headers.quant_tables(segs).collect()] == list(range(1, 17))
    assert [(t["class"], t.dest) for t in headers.huffman_tables(segs).collect()] == [(t % 2, t // 2) for t in range(16)]


def test_stream_of_files(spark, tmp_path):
    from blockloom.streaming import stream_frames, stream_images

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jpg").write_bytes(encode.gray_image(gray_blocks(1, k), 8, 8, [1] * 64))
    query = stream_frames(stream_images(spark, str(tmp_path / "in"), "*.jpg")).writeStream.format("memory").queryName("frames_seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("frames_seen").count() == 3
