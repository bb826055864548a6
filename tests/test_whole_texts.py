"""The queries over documents take whole texts of any length, null and empty ones among them."""

import pytest

from blockloom import queries

TEXTS = {1: "short", 2: None, 3: "", 4: "x" * 65533, 5: "y" * 65534, 6: "é" * 40_000 + "日本", 7: "ab" * 100_000}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def payload(doc):
    return (TEXTS[doc] or "").encode()


def framed(doc):
    body = payload(doc)
    parts = [body[k : k + 65533] for k in range(0, len(body), 65533)] or [b""]
    return parts, b"\xff\xd8" + b"".join(b"\xff\xfe" + (len(p) + 2).to_bytes(2) + p for p in parts) + b"\xff\xd9"


def test_every_text_is_framed(spark, tables):
    import hashlib

    want = {d: (True, len(s), hashlib.md5(s).hexdigest()) for d in TEXTS for _, s in [framed(d)]}
    assert {r.doc_id: (r.is_image, r.length, r.digest) for r in queries.frame_magic(spark, tables).collect()} == want


def test_every_segment_is_found(spark, tables):
    import hashlib

    want = []
    for d in TEXTS:
        at = 6
        for seq, part in enumerate(framed(d)[0]):
            want.append((d, seq, at, len(part), hashlib.md5(part).hexdigest()))
            at += len(part) + 4
    assert sorted(map(tuple, queries.segment_payload(spark, tables).collect())) == want


def test_every_marker_is_found(spark, tables):
    want = {}
    for d in TEXTS:
        s = framed(d)[1]
        for i in range(len(s) - 1):
            if s[i] == 0xFF and s[i + 1] not in (0, 0xFF):
                want.setdefault((d, s[i + 1]), []).append(i)
    assert sorted((r.doc_id, r.pos, r.code) for r in queries.marker_scan(spark, tables).collect()) == sorted((d, i, c) for (d, c), own in want.items() for i in own)
    assert {(r.doc_id, r.code): (r.n, r.first_pos, r.last_pos) for r in queries.marker_groups(spark, tables).collect()} == {k: (len(v), v[0], v[-1]) for k, v in want.items()}


def test_every_byte_is_expanded(spark, tmp_path):
    every = "".join(map(chr, range(0x110))) + "é日本𝄞\x00\n"
    texts = {1: every, 2: None, 3: "", 4: "\x00", 5: "three short lines\n" * 20, 6: "y" * 70_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(d, i, format(v, "08b")) for d, t in texts.items() for i, v in enumerate((t or "").encode())]
    assert sorted(map(tuple, queries.bit_expand(spark, str(tmp_path)).collect())) == want
