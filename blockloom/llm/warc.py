"""Operator 4: WARC archives, with a reader that salvages damaged ones.

Writing: payloads are compared by SHA-1; of records with equal payloads of at least
`revisit_from` bytes, the one with the largest id is the response and the others are revisits of it.
Digests alone are grouped; entries of repeated digests are broadcast while they number at most BROADCAST_DIGESTS, which is counted first, else
payloads meet them by digest, hot ones apart. Each record is a gzip member, as the format recommends. Archives go out
through Spark's text sink, so they land in any store that Spark can write, cut by bytes: a row of the sink is an archive of
at most `archive_bytes`, or one longer record. An archive's last byte, the
highest of its last member's length, is 0 below 16 MB and is left to the sink's line separator (U+0000). A longer
member is followed by that byte as padding, which the reader skips.

Reading: each archive is scanned as a byte string, plain or gzip with any number of records in a member. A record must start with a version line, have a header of
named fields that ends in an empty line, a content length that fits, and a block followed by the
two line ends; its block and payload must agree with the digests that it names (SHA-1, SHA-256, SHA-512 or MD5, in hex or base32;
others are not checked). The payload of an HTTP response or request is what follows its HTTP header, of any other record the
block. After a failed check the reader searches for the next version line or gzip member, goes on there, and logs the bytes
between as a quarantined gap, so later records are recovered, within a member, too: gaps there
have the member's offset and places in its content. Each byte is searched once for each sign, however many checks fail. An archive
is held in memory whole, so those of 2 GB and more have to be split before.

Defined results: a null or empty payload is a record of no bytes; equal ids are written as records of their own; a null id is written and read as null and
is the response among equal payloads only if all their ids are null; an
empty table writes no record and reads back as no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import HOT_SHARE
from .tables import materialize

#: So many entries of repeated digests, of 20 bytes and an id each, are broadcast at most.
BROADCAST_DIGESTS = 100_000
VERSION = re.compile(rb"WARC/[01]\.\d+\r?\n")
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, archive string, offset long, inner_offset long, payload binary"
GAPS = "archive string, start long, stop long, member long, reason string"
#: The record id of a row with a null id.
NO_ID = "urn:x-record-null"


def header(kind: str, record_id: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), *fields, ("Content-Length", str(length))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n"


def one_line(text: str | None) -> str:
    """A URI as a header value: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def named(record_id) -> str:
    """An id as a record's."""
    return NO_ID if record_id is None else f"urn:x-record:{record_id}"


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A whole record without the END; revisits carry the digest and length of their payload in fields."""
    fields = [("WARC-Target-URI", one_line(uri)), ("WARC-Payload-Digest", base32(digest))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
        block = b""
    else:
        block = payload
    fields.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()))
    return header(kind, record_id, fields, len(block)) + block


def payload_of(fields: dict, block: bytes) -> bytes:
    """What a record's payload digest is of: the block, or the body of an HTTP message."""
    if fields.get("content-type", "").lower().startswith("application/http"):
        ends = [m.end() for m in [re.search(rb"\r?\n\r?\n", block)] if m]
        return block[ends[0] :] if ends else b""
    return block


def agrees(said: str, content: bytes) -> bool:
    """Whether a digest like sha1:... is that of the content; True where its algorithm or form is unknown."""
    name, _, value = said.partition(":")
    if name.lower().replace("-", "") not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(name.lower().replace("-", ""), content)
    if re.fullmatch(r"[0-9a-fA-F]+", value) and len(value) == 2 * own.digest_size:
        return value.lower() == own.hexdigest()
    return value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(fields, block, end) of the record at `at`; ValueError says which check failed."""
    m = VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    fields, line = {}, m.end()
    while True:
        stop = data.find(b"\n", line)
        if stop < 0:
            raise ValueError("header does not end")
        text = data[line:stop].rstrip(b"\r")
        line = stop + 1
        if not text:
            break
        name, colon, value = text.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise ValueError("header line without a field name")
        fields[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise ValueError("no content length")
    stop = line + int(fields["content-length"])
    if stop > len(data):
        raise ValueError("block is cut off")
    if not data.startswith(END, stop):
        raise ValueError("block does not end in two line ends")
    block = data[line:stop]
    if not agrees(fields.get("warc-block-digest", ""), block):
        raise ValueError("warc-block-digest differs")
    # A revisit's payload is elsewhere, a segment's is a part.
    if fields.get("warc-type") in ("response", "resource", "request") and "warc-segment-number" not in fields and not agrees(fields.get("warc-payload-digest", ""), payload_of(fields, block)):
        raise ValueError("warc-payload-digest differs")
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise ValueError("record without type or id")
    return fields, block, stop + len(END)


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What can be read of the gzip member at `at`, its end, and what is wrong with it (empty: nothing)."""
    machine, view, out = zlib.decompressobj(31), memoryview(data), []
    while not machine.eof:
        if at >= len(data):
            return b"".join(out), at, "gzip member is cut off"
        try:
            out.append(machine.decompress(view[at : at + 32768]))
        except zlib.error:
            return b"".join(out), at, "gzip member is damaged"
        at = min(at + 32768, len(data))
    return b"".join(out), at - len(machine.unused_data), ""


class Forward:
    """The next place of a sign, for places asked in ascending order: found places are kept until they are passed."""

    def __init__(self, find):
        self.find, self.place = find, -1

    def after(self, at: int) -> int:
        if self.place is not None and self.place < at:
            self.place = self.find(at)
        return self.place


Found = list[tuple[int, int, dict, bytes]]
Gaps = list[tuple[int, int, int | None, str]]


def _plain(data: bytes, member: int | None) -> tuple[Found, Gaps]:
    """The records of one gzip member's content, and the gaps between them."""
    versions = Forward(lambda at: m.start() if (m := VERSION.search(data, at)) else None)
    records, gaps, at, lost, reason = [], [], 0, 0, ""
    while at < len(data):
        try:
            fields, block, end = parse(data, at)
        except ValueError as e:
            if not reason:
                reason, lost = str(e), at
            found = versions.after(at + 1)
            at = len(data) if found is None else found
            continue
        if reason:
            gaps.append((lost, at, member, reason))
        reason = ""
        records.append((member, at, fields, block))
        at = end
    if reason:
        gaps.append((lost, len(data), member, reason))
    return records, gaps


def salvage_places(data: bytes) -> tuple[Found, Gaps]:
    """All records that pass their checks, as (offset, offset in its member's content, fields, block), and the gaps.

    A gap is (start, stop, member, reason): bytes of the archive, or where member isn't null of what the member at that offset holds.
    """
    versions = Forward(lambda at: m.start() if (m := VERSION.search(data, at)) else None)
    members = Forward(lambda at: x if (x := data.find(MEMBER, at)) >= 0 else None)
    records, gaps, at, reason, lost = [], [], 0, "", 0

    def resume(where: int) -> None:
        if reason:
            gaps.append((lost, where, None, reason))

    while at < len(data):
        found, inner, why = [], [], ""
        if data.startswith(MEMBER, at):
            plain, end, why = inflate(data, at)
            # Inside a damaged member records may be whole up to the damage.
            if VERSION.search(plain):
                found, inner = _plain(plain, at)
            if why or not found:
                why = why or (inner[0][3] if inner else "no version line")
                inner = []
        else:
            try:
                fields, block, end = parse(data, at)
                found = [(at, 0, fields, block)]
            except ValueError as e:
                why = str(e)
        records += found
        if why:
            if not reason:
                reason, lost = why, at
            places = [x for x in (versions.after(at + 1), members.after(at + 1)) if x is not None]
            at = min(places, default=len(data))
            continue
        resume(at)
        reason = ""
        gaps += inner
        at = end
        while data.startswith(b"\0", at):
            at += 1
    resume(len(data))
    return records, gaps


def salvage(data: bytes) -> tuple[list[tuple[int, dict, bytes]], list[tuple[int, int, str]]]:
    """salvage_places() as (offset, fields, block) and (start, stop, reason)."""
    records, gaps = salvage_places(data)
    return [(offset, fields, block) for offset, _, fields, block in records], [(a, b, why) for a, b, _, why in gaps]


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", revisit_from: int = 1000) -> DataFrame:
    """id, uri, payload, digest and refers_to (null: a response) of each row of pages."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    long = rows.where(F.length("payload") >= revisit_from)
    # Of ids and digests alone: payloads are read once more below, where they are written.
    groups = long.groupBy("digest").agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    groups = materialize(groups, "digests")
    known = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("__n").alias("rows")).first()
    if known["groups"] <= BROADCAST_DIGESTS:
        table = groups.withColumnRenamed("digest", "__digest")
        met = rows.join(F.broadcast(table), (F.col("digest") == F.col("__digest")) & (F.length("payload") >= revisit_from), "left").drop("__digest")
    else:
        hot = groups.where(F.col("__n") > known["rows"] * HOT_SHARE)  # at most 1 / HOT_SHARE
        on, large = F.col("digest") == F.col("__digest"), F.length("payload") >= revisit_from
        first = rows.join(F.broadcast(hot.select(F.col("digest").alias("__digest"), F.col("newest").alias("__newest"))), on & large, "left")
        rest = first.where("__digest IS NULL").drop("__digest", "__newest")
        others = groups.join(hot.select("digest"), "digest", "left_anti").select(F.col("digest").alias("__digest"), "newest", "__n")
        met = first.where("__digest IS NOT NULL").select(*rows.columns, F.col("__newest").alias("newest"), F.lit(2).cast("long").alias("__n"))
        met = met.unionByName(rest.join(others, on & large, "left").select(*rows.columns, "newest", "__n"))
    # Of rows with a null id beside others all are revisits, of null ids alone none.
    revisit = F.coalesce(F.col("__n").isNotNull() & F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("id")), F.lit(False))
    return met.select("id", "uri", "payload", F.lower(F.hex("digest")).alias("digest"), F.when(revisit, F.col("newest")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", revisit_from: int = 1000, archive_bytes: int = 32 << 20, records_per_file: int | None = None) -> None:
    """Write one record per row to archives of at most `archive_bytes` each, or one longer record, and at most `records_per_file` records, below `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held).removesuffix(b"\0")], pa.binary())], names=["value"])

        for batch in batches:
            for i in range(len(batch)):
                x = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                kind = "response" if x["refers_to"] is None else "revisit"
                whole = record(kind, named(x["id"]), x["uri"], x["payload"], x["digest"], named(x["refers_to"])) + END
                member = gzip.compress(whole, 6, mtime=0)
                if held and (size + len(member) > archive_bytes or len(held) == records_per_file):
                    yield archive()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield archive()

    rows = plan_records(pages, id_col, payload_col, uri_col, revisit_from).mapInArrow(run, "value binary")
    rows = rows.select(F.col("value").cast("string"))  # the bytes pass unchanged
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row of RECORDS for each record below `path` that passes its checks; payload is null if `payloads` is false."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("inner_offset", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name = batch.column(0)[i].as_py()
                out, size = [], 0
                for offset, inner, fields, block in salvage_places(batch.column(1)[i].as_py())[0]:
                    out.append(_row(fields, block, name, offset, inner, payloads))
                    size += len(out[-1]["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _archives(spark, path).mapInArrow(run, RECORDS)


def _row(fields: dict, block: bytes, name: str, offset: int, inner: int, payloads: bool) -> dict:
    kind = fields["warc-type"]
    digest = fields.get("warc-payload-digest", "")
    payload = None if kind == "revisit" else payload_of(fields, block)
    if payload is None:
        length = int(fields["x-payload-length"]) if re.fullmatch(r"\d{1,18}", fields.get("x-payload-length", "")) else None
        if re.fullmatch(r"sha1:[A-Za-z2-7]{32}", digest):
            known = base64.b32decode(digest[5:].upper()).hex()
        else:
            known = digest[5:].lower() if re.fullmatch(r"sha1:[0-9a-fA-F]{40}", digest) else None
    else:
        length, known = len(payload), hashlib.sha1(payload).hexdigest()
    return {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_bytes": length, "payload_digest": known, "archive": name, "offset": offset, "inner_offset": inner, "payload": payload if payloads else None}


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """One row of GAPS for each run of bytes below `path` that belongs to no valid record."""
    schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("member", pa.int64()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name = batch.column(0)[i].as_py()
                out = [{"archive": name, "start": a, "stop": b, "member": m, "reason": why} for a, b, m, why in salvage_places(batch.column(1)[i].as_py())[1]]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return _archives(spark, path).mapInArrow(run, GAPS)
