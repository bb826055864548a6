"""Operator 4: exact round trips and salvage of damaged archives."""

import gzip
import hashlib
import random

import pytest

from blockloom.llm import warc
from blockloom.llm.queries import op4_warc


def records(n=20):
    rng = random.Random(1)
    out = []
    for k in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 300))) + (b"WARC/1.1\r\nfake\r\n\r\n" if k % 5 == 0 else b"")
        out.append((f"urn:x-record:{k}", payload, warc.record("response", f"urn:x-record:{k}", f"http://e/{k} \r\nx", payload, hashlib.sha1(payload).hexdigest()) + warc.END))
    return out


def archive(own, packed):
    return b"".join(gzip.compress(r, mtime=0) if packed else r for _, _, r in own)


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_reads_whole_archives(packed):
    own = records()
    found, gaps = warc.salvage(archive(own, packed))
    assert [(f["warc-record-id"], b) for _, f, b in found] == [(f"<{i}>", p) for i, p, _ in own] and gaps == []


@pytest.mark.parametrize("packed", [False, True])
def test_records_of_very_long_urls(packed):
    url = "http://e/" + "x y" * 50_000
    whole = warc.record("response", "urn:x-record:1", url, b"page", hashlib.sha1(b"page").hexdigest()) + warc.END
    found, gaps = warc.salvage(archive([("", b"", whole)], packed))
    assert [(f["warc-target-uri"], b) for _, f, b in found] == [(url.replace(" ", "%20"), b"page")] and gaps == []


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("damage", ["flip", "cut", "junk", "tail", "length"])
def test_salvage_recovers_later_records(packed, damage):
    own = records()
    parts = [gzip.compress(r, mtime=0) if packed else r for _, _, r in own]
    bad = parts[7]
    if damage == "flip":
        k = len(bad) - 20
        parts[7] = bad[:k] + bytes([bad[k] ^ 0x55]) + bad[k + 1 :]
    elif damage == "cut":
        parts[7] = bad[: len(bad) // 2]
    elif damage == "junk":
        parts[7] = b"some junk\n" + b"\x1f\x8b" + bad[:5]
    elif damage == "length":
        parts[7] = bad.replace(b"Content-Length: ", b"Content-Length: 9") if not packed else bad[:-1] + b"\x01"
    else:
        parts[7] = b""
        parts.append(b"\x1f\x8b\x08trailing")
    data = b"".join(parts)
    found, gaps = warc.salvage(data)
    names = [f["warc-record-id"].strip("<>") for _, f, _ in found]
    want = [i for k, (i, _, _) in enumerate(own) if k != 7]
    assert [n for n in names if n != "urn:x-record:7"] == want
    assert len(gaps) == 1 and gaps[0][2]
    covered = sum(b - a for a, b, _ in gaps)
    assert covered == (len(parts[7]) if damage != "tail" else len(parts[-1]))


def test_empty_archive():
    assert warc.salvage(b"") == ([], [])
    assert warc.salvage(b"nothing here") == ([], [(0, 12, "no version line")])


@pytest.fixture
def pages(spark):
    long, longer = "é" * 600, "z" * 2000
    rows = [(1, "http://a/1", long, "x"), (2, "http://a/2", long, "x"), (3, "u", "short", "x"), (4, "u", "short", "x"), (5, None, None, "x"), (6, "u", "", "x"), (7, "u", longer, "x"), (9, "u", longer, "x"), (8, "u", longer, "x"), (8, "u", longer, "x"), (10, "a b", "w" * 999, "x"), (11, "u", "w" * 999, "x"), (12, "u", "q" * (17 << 20), "x"), (13, "u", "nul\0\r\n\r\nWARC/1.1\r\n", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_archives_in_spark(spark, pages, tmp_path):
    path = str(tmp_path / "out")
    warc.write_archives(pages, path, records_per_file=4)
    got = sorted((int(r.record_id.split(":")[-1]), r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_archives(spark, path).drop("payload").collect())
    newest = {}
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    for i, b in rows:
        newest[b] = max(i, newest.get(b, i))
    want = []
    for i, b in rows:
        again = len(b) >= 1000 and newest[b] != i
        want.append((i, "revisit" if again else "response", len(b), hashlib.sha1(b).hexdigest(), f"urn:x-record:{newest[b]}" if again else None))
    assert got == sorted(want, key=lambda r: r[:2])
    payloads = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert payloads["urn:x-record:13"] == b"nul\0\r\n\r\nWARC/1.1\r\n" and len(payloads["urn:x-record:12"]) == 17 << 20
    assert warc.read_gaps(spark, path).count() == 0


def test_rows_without_an_id(spark, tmp_path):
    same = "z" * 2000
    for name, rows in (("some", [(None, "u", same), (None, "u", None), (7, "u", same)]), ("all", [(None, "u", same), (None, "v", same)])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / name / "pages.parquet"))
        got = sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to) for r in op4_warc(spark, str(tmp_path / name)).collect())
        assert got == ([(0, "response", 0, None), (0, "revisit", 2000, 7), (7, "response", 2000, None)] if name == "some" else [(0, "response", 2000, None)] * 2)


def test_many_repeated_digests(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "HOT_SHARE", 0.4)
    key = lambda r: (r.id, r.digest, r.refers_to or 0)
    split = sorted(warc.plan_records(pages).drop("payload").collect(), key=key)
    monkeypatch.undo()
    assert split == sorted(warc.plan_records(pages).drop("payload").collect(), key=key)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, "u", "".join(chr(rng.randrange(33, 0x2000)) for _ in range(4000))) for k in range(60)] + [(100, "u", "".join(chr(rng.randrange(33, 0x2000)) for _ in range(90_000)))]
    path = tmp_path / "out"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(path), archive_bytes=60_000)
    sizes = [p.stat().st_size for p in path.iterdir() if p.name.startswith("part")]
    assert len(sizes) > 5 and sum(s > 60_000 for s in sizes) == 1
    assert warc.read_archives(spark, str(path)).count() == 61 and warc.read_gaps(spark, str(path)).count() == 0


def http_record(digest, k=1):
    body = f"<p>page {k}</p>".encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body))]
    return body, warc.header("response", f"urn:x-record:{k}", fields, len(block)) + block + warc.END


@pytest.mark.parametrize("form", ["base32", "hex", "sha256", "md5", "unknown"])
def test_http_responses_with_digests_of_their_bodies(form):
    import base64

    digest = {"base32": lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode(), "hex": lambda b: "sha1:" + hashlib.sha1(b).hexdigest(), "sha256": lambda b: "sha256:" + hashlib.sha256(b).hexdigest(), "md5": lambda b: "md5:" + hashlib.md5(b).hexdigest().upper(), "unknown": lambda b: "crc9:1"}[form]
    body, whole = http_record(digest)
    found, gaps = warc.salvage(whole)
    assert len(found) == 1 and gaps == [] and warc.payload_of(found[0][1], found[0][2]) == body
    if form != "unknown":
        assert warc.salvage(http_record(lambda b: digest(b + b"!"))[1])[1][0][2] == "warc-payload-digest differs"


def test_records_inside_one_member():
    own = records(6)
    parts = [r for _, _, r in own]
    found, gaps = warc.salvage_places(gzip.compress(b"".join(parts), mtime=0))
    assert [(m, f["warc-record-id"]) for m, _, f, _ in found] == [(0, f"<{i}>") for i, _, _ in own] and gaps == []
    assert [x for _, x, _, _ in found] == [sum(map(len, parts[:k])) for k in range(6)]
    parts[2] = parts[2][:60] + b"?" + parts[2][61:-8] + b"??"
    whole = gzip.compress(b"".join(parts), mtime=0)
    found, gaps = warc.salvage_places(b"junk" + whole)
    assert [f["warc-record-id"] for _, _, f, _ in found] == [f"<{i}>" for k, (i, _, _) in enumerate(own) if k != 2]
    assert [(a, b, m) for a, b, m, _ in gaps] == [(0, 4, None), (len(parts[0] + parts[1]), len(b"".join(parts[:3])), 4)]
    cut, gaps = warc.salvage_places(whole[: len(whole) * 2 // 3])
    assert cut and gaps == [(0, len(whole) * 2 // 3, None, "gzip member is cut off")]


def test_search_is_linear():
    import time

    took = []
    for n in (40_000, 400_000):
        data = (b"\x1f\x8b\x08\xffxx" + b"y" * 20) * n  # a false member every 26 bytes, and no version line
        start = time.process_time()
        assert warc.salvage(data)[0] == []
        took.append(time.process_time() - start)
    assert took[1] < 25 * took[0] + 1


def test_gaps_in_spark(spark, pages, tmp_path):
    path = tmp_path / "out"
    warc.write_archives(pages.coalesce(1), str(path), records_per_file=100)
    (file,) = [p for p in path.iterdir() if p.name.startswith("part")]
    data = file.read_bytes()
    (path / ("." + file.name + ".crc")).unlink()
    file.write_bytes(data[:40] + b"????" + data[44:])
    assert warc.read_archives(spark, str(path)).count() == 13
    (gap,) = warc.read_gaps(spark, str(path)).collect()
    assert gap.start == 0 and gap.reason


def test_no_pages(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
