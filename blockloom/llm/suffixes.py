"""Operator 8: bytes that repeat from document to document, by merged Burrows-Wheeler transforms.

A byte is removed if a string of LENGTH bytes covers it that also starts in a document with a smaller id.

1. Every string of LENGTH bytes has an *anchor*, the leftmost smallest of its hashed K-byte substrings. Consecutive strings
   with one anchor form a *window*. Equal strings have equal anchors, so only windows of anchors
   that occur in two documents can repeat; an exact global lookup (see chunks) tells them.
2. The windows of such an anchor are compared by hash over all chunks. Where all are the same bytes, they are one
   repeated interval, and the smallest document of any of them is that of each of its strings.
3. The others go to the anchor's owner. There each chunk's windows are a shard with a Burrows-Wheeler transform of
   its own, over symbols of `g` bytes. The shards' transforms are merged by iterative interleave refinement: from
   any interleaving, one stable pass over the merged transform sorts it g bytes deeper, without comparing or sorting
   suffixes again; the passes also carry along where neighbours differ, so after LENGTH bytes they have derived
   the common prefixes, and the intervals between the differences are the repeated strings. The smallest document
   of each interval goes back to the strings.

Anchors with over HOT windows skip step 2: their strings are dealt out by the strings' own hashes, so no task
holds a boilerplate line's variants. All exchanges hold one entry per chunk and distinct key or window.

Defined results: null and empty texts and texts under LENGTH bytes lose nothing; documents with equal ids don't remove
from each other; ids must be whole numbers, and rows with a null id neither lose nor remove; an empty table
gives no row; texts are taken whole, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SENT, Chunks, deltas, exchange, pack, pack_ids, range_count, ranges, sender, small, unpack, unpack_ids
from .tables import growth, pieces
from .text import Runs, flat_bytes, mix, window_hashes

LENGTH = 50
K = 24
HOT = 20_000
#: Bytes of text for each key range of steps 1 and 2, and of step 3, times tables.growth.
RANGE_BYTES, WINDOW_BYTES = 16 << 20, 2 << 20
#: Bytes of text that windows are found in at once, unless a document is longer.
PIECE_BYTES = 1 << 18
#: Anchors are looked up by the top bits of their hashes.
ANCHOR_MASK = np.uint64(2**64 - 2**16)
NOWHERE = np.int64(2**63 - 1)
UNIQUE, REPEATED, SPREAD = 0, 1, 2


def windows(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, anchor position) of all windows, in order."""
    n = len(data) - k + 1
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3
    runs = Runs(data)
    low = mix((runs.sums[k:] - runs.sums[:-k]) * runs.down[:n])
    at, reach, width = np.arange(n, dtype=np.int32), 1, length - k + 1
    while reach < width:
        step = min(reach, width - reach)
        other = low[step:] < low[:-step]
        low, at = np.where(other, low[step:], low[:-step]), np.where(other, at[step:], at[:-step])
        reach += step
    del low
    inside = np.zeros(len(at) + 1, np.int8)  # starts of strings that stay within a document
    lengths = np.diff(offsets)
    some = lengths >= length
    inside[offsets[:-1][some]] = 1
    inside[offsets[1:][some] - length + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    begins = inside.copy()
    begins[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    begins[offsets[:-1][some]] = True
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + length, at[start].astype(np.int64)


def _chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, window starts, window ends, anchor positions, row of each window)."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]), np.uint8)
    lengths, start, size, ahead = unpack(row["windows"])
    offsets = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
    start = np.cumsum(start.astype(np.int64))
    return data, offsets, start, start + size, start + ahead, np.searchsorted(offsets, start, side="right") - 1


def _documents(row: dict) -> np.ndarray:
    """The ids, NOWHERE for a null one."""
    return unpack_ids(row["ids"]).fill_null(int(NOWHERE)).to_numpy(zero_copy_only=False).astype(np.int64)


def _first(order_keys: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(1, len(order_keys)), bool), order_keys[1:] != order_keys[:-1]])


def _told(row: dict, name: str, count: int, offset: int = 0) -> list[list[np.ndarray]]:
    """The unpacked answers of an exchange, for bucket numbers from offset to offset + count, in order."""
    return [unpack(a["blob"]) for a in row[name] or [] if offset <= a["bucket"] < offset + count]


# Step 1: which anchors are in several documents.
def _anchor_keys(row: dict) -> tuple:
    chunk = _chunk(row)
    data, _, start, end, anchor, owner = chunk
    return chunk, window_hashes(data, anchor, anchor + K)


def _send_anchors(count: int):
    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        (*_, owner), keys = _anchor_keys(row)
        masked = keys & ANCHOR_MASK
        order = np.argsort(masked, kind="stable")
        keys, owner = masked[order], owner[order]
        at = np.flatnonzero(_first(keys))
        if not len(at):
            return
        several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        times = np.minimum(np.diff(np.append(at, len(keys))), 65535).astype(np.uint16)
        keys = keys[at]
        for b, i, j in ranges(keys, count):
            yield b, pack(deltas(keys[i:j]), several[i:j].astype(np.uint8), times[i:j])

    return emit


def _answer_anchors(hot: int):
    def answer(blobs: list[bytes]) -> list[bytes]:
        parts = [unpack(b) for b in blobs]
        keys = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in parts])
        several = np.concatenate([s for _, s, _ in parts]).astype(np.int64)
        times = np.concatenate([t for _, _, t in parts]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        new = _first(keys[order])
        at = np.flatnonzero(new)
        chunks = np.diff(np.append(at, len(keys)))
        state = np.where((chunks > 1) | (np.add.reduceat(several[order], at) > 0), REPEATED, UNIQUE)
        state[(state == REPEATED) & (np.add.reduceat(times[order], at) > hot)] = SPREAD
        out = np.empty(len(keys), np.uint8)
        out[order] = state[np.cumsum(new) - 1]
        return [pack(x) for x in np.split(out, np.cumsum([len(p[0]) for p in parts])[:-1])]

    return answer


def _states(row: dict, keys: np.ndarray) -> np.ndarray:
    """The state of each window's anchor, from the answers to step 1."""
    if not len(keys):
        return np.empty(0, np.uint8)
    return np.concatenate([a[0] for a in _told(row, "answers0", 1 << 40)])[np.unique(keys & ANCHOR_MASK, return_inverse=True)[1]]


# Step 2: which of them have one window only, and its smallest document.
def _variants(row: dict) -> tuple:
    """The chunk, its repeated windows, their entries (anchor, window hash, smallest id) and each window's entry."""
    chunk, keys = _anchor_keys(row)
    data, _, start, end, _, owner = chunk
    states = _states(row, keys)
    ids = _documents(row)
    some = np.flatnonzero((states == REPEATED) & (ids[owner] != NOWHERE))
    key, own = keys[some], window_hashes(data, start[some], end[some])
    order = np.lexsort((own, key))
    new = _first(key[order]) | _first(own[order])
    at = np.flatnonzero(new)
    entry = np.empty(len(some), np.int64)
    entry[order] = np.cumsum(new) - 1
    lowest = np.minimum.reduceat(ids[owner[some]][order], at) if len(at) else np.empty(0, np.int64)
    example = some[order][at]
    return chunk, states, ids, some, entry, key[order][at], own[order][at], lowest, example


def _send_variants(count: int):
    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        *_, key, own, lowest, _ = _variants(row)
        for b, i, j in ranges(key, count):
            yield b, pack(deltas(key[i:j]), own[i:j], lowest[i:j])

    return emit


def _answer_variants(blobs: list[bytes]) -> list[bytes]:
    parts = [unpack(b) for b in blobs]
    key = np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _, _ in parts])
    own, ids = np.concatenate([w for _, w, _ in parts]), np.concatenate([d for _, _, d in parts])
    order = np.lexsort((own, key))
    new_key = _first(key[order])
    new = new_key | _first(own[order])
    lowest = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
    smallest, several = np.empty(len(key), np.int64), np.empty(len(key), np.uint8)
    smallest[order], several[order] = lowest, kinds > 1
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return [pack(a, b) for a, b in zip(np.split(several, cuts), np.split(smallest, cuts), strict=True)]


# Step 3: repeated intervals of the other windows.
def _to_merge(row: dict) -> tuple:
    """What a chunk knows after step 2, with the spans that step 3 gets: (start, end, smallest id) by range key."""
    chunk, states, ids, some, entry, key, own, lowest, example = _variants(row)
    data, _, start, end, _, owner = chunk
    answers = _told(row, "answers1", 1 << 40)
    several = np.concatenate([a[0] for a in answers]).astype(bool) if answers else np.empty(0, bool)
    smallest = np.concatenate([a[1] for a in answers]) if answers else np.empty(0, np.int64)
    pick = np.flatnonzero(several)
    # Strings of spread anchors, each once with its smallest id.
    spread = np.flatnonzero((states == SPREAD) & (ids[owner] != NOWHERE))
    counts = end[spread] - start[spread] - LENGTH + 1
    begin = np.repeat(start[spread] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    hashes = window_hashes(data, begin, begin + LENGTH)
    order = np.argsort(hashes, kind="stable")
    new = _first(hashes[order])
    string = np.empty(len(begin), np.int64)
    string[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    string_low = np.minimum.reduceat(np.repeat(ids[owner[spread]], counts)[order], at) if len(at) else np.empty(0, np.int64)
    first = begin[order][at]
    merged = [(key[pick], start[example[pick]], end[example[pick]], smallest[pick]), (hashes[order][at], first, first + LENGTH, string_low)]
    return chunk, ids, some, entry, several, smallest, pick, spread, counts, begin, string, merged


def _send_windows(count: int):
    def emit(row: dict) -> Iterator[tuple[int, bytes]]:
        chunk, *_, merged = _to_merge(row)
        data = chunk[0]
        for kind, (key, start, end, low) in enumerate(merged):
            for b, i, j in ranges(key, count):
                sizes = end[i:j] - start[i:j]
                place = np.repeat(start[i:j] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                yield kind * count + b, pack(sizes.astype(np.uint8), data[place], low[i:j], level=3)

    return emit


def _symbols(texts: list[np.ndarray]) -> tuple[int, list[list[np.ndarray]]]:
    """A number of bytes g whose runs have 65,536 values at most, and for g bytes and for the rest of LENGTH the ranks."""
    whole = np.concatenate(texts)
    cuts = np.cumsum([len(t) for t in texts])[:-1]

    def packed(g: int) -> np.ndarray:
        value = np.zeros(len(whole), np.int64)
        for i in range(g):  # a shard is a circle, so its orders by steps of g bytes and of the rest agree
            value = value << 8 | np.concatenate([np.roll(t, -i) for t in texts])
        return value

    def ranks(g: int) -> tuple[int, np.ndarray]:
        value = packed(g)
        if g <= 2:
            there = np.zeros(1 << 8 * g, bool)
            there[value] = True
            table = np.cumsum(there, dtype=np.int32)
            return int(table[-1]), table[value] - 1
        values, inverse = np.unique(value, return_inverse=True)
        return len(values), inverse

    g, (count, own) = 2, ranks(2)
    for more in (3, 4, 5, 6):
        if count > 65536 // 6:  # one byte more would hardly fit
            break
        found, after = ranks(more)
        if found > 65536:
            break
        g, count, own = more, found, after
    split = lambda x: np.split(x.astype(np.uint16), cuts)
    return g, [split(own), split(ranks(LENGTH % g)[1]) if LENGTH % g else []]


def transform(ranks: np.ndarray, rest: np.ndarray | None, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """A shard's suffix order to LENGTH bytes and more, and its transforms: the symbols of g bytes before, and of the rest."""
    n = len(ranks)
    before = np.roll(np.arange(n, dtype=np.int32), g)  # the place g bytes before each
    order, symbols = np.arange(n, dtype=np.int32), ranks[before]
    for _ in range(-(-LENGTH // g)):
        order = before[order[np.argsort(symbols[order], kind="stable")]]
    return order, symbols[order], rest[(order - LENGTH % g) % n] if rest is not None else None


def merge(transforms: list[tuple[np.ndarray, np.ndarray | None]], g: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of shards' transforms to LENGTH bytes: (place in the shards' joined orders, new-prefix mask).

    Entry i of the result is the i-th suffix of all, as its place in the concatenation of the shards' suffix orders;
    the mask is true where its first LENGTH bytes differ from those of the suffix before.
    """
    sizes = np.array([len(t[0]) for t in transforms])
    whole = np.concatenate([t[0] for t in transforms])
    rest = np.concatenate([t[1] for t in transforms]) if LENGTH % g else None
    kind = np.uint8 if len(sizes) < 256 else np.uint16 if len(sizes) < 65536 else np.int64
    shard = np.repeat(np.arange(len(sizes)), sizes).astype(kind)
    place = entries = np.arange(len(whole), dtype=np.int32)
    new = np.zeros(len(whole), bool)
    for symbols in [whole] * (LENGTH // g) + ([rest] if rest is not None else []):
        seen = symbols[place]  # the merged transform at this depth
        order = np.argsort(seen, kind="stable")
        seen, group = seen[order], np.cumsum(new, dtype=np.int32)[order]
        new[1:] = (seen[1:] != seen[:-1]) | (group[1:] != group[:-1])
        if len(sizes) == 1:
            place = entries
            continue
        shard = shard[order]
        # The k-th entry of a shard in the interleaving is the k-th of its own order.
        place = np.empty(len(whole), np.int32)
        place[np.argsort(shard, kind="stable")] = entries
    return place, new


def smallest_ids(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For shards (sizes, bytes, id of each window): the smallest id of any window that holds each string."""
    if not shards:
        return []
    texts = [s[1] for s in shards]
    g, (ranks, rest) = _symbols(texts)
    built = [transform(r, rest[k] if rest else None, g) for k, r in enumerate(ranks)]
    place, new = merge([(b[1], b[2]) for b in built], g)
    starts, value = [], []
    for sizes, text, ids in shards:
        sizes = sizes.astype(np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(text))
        starts.append(left >= LENGTH)  # strings, not the windows' last bytes
        value.append(np.where(left >= LENGTH, np.repeat(ids, sizes), NOWHERE))
    joined = np.concatenate([v[b[0]] for v, b in zip(value, built, strict=True)])
    at = np.flatnonzero(np.concatenate([[True], new[1:]]))
    low = np.minimum.reduceat(joined[place], at)
    group = np.empty(len(place), np.int64)
    group[place] = np.cumsum(np.concatenate([[False], new[1:]]))
    out, base = [], 0
    for b, mask in zip(built, starts, strict=True):
        own = np.empty(len(mask), np.int64)
        own[b[0]] = low[group[base : base + len(mask)]]
        out.append(own[mask])
        base += len(mask)
    return out


def _answer_windows(blobs: list[bytes]) -> list[bytes]:
    """One shard per blob, without windows that an earlier shard holds."""
    parts = [unpack(b) for b in blobs]
    known: dict[bytes, int] = {}
    shards, where = [], []
    texts, lows = [], []
    for shard, (sizes, text, low) in enumerate(parts):
        ends = np.cumsum(sizes.astype(np.int64))
        raw, own, place = text.tobytes(), [], np.empty(len(sizes), np.int64)
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            w = raw[a:b]
            at = known.get(w)
            if at is None:
                at = known[w] = len(texts)
                texts.append(w)
                lows.append(low[k])
                own.append(at)
            else:
                lows[at] = min(lows[at], low[k])
            place[k] = at
        where.append(place)
        shards.append(own)
    used = [own for own in shards if own]
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    given = [(np.array([len(texts[k]) for k in own], np.int64), np.frombuffer(b"".join([texts[k] for k in own]), np.uint8), np.array([lows[k] for k in own], np.int64)) for own in used]
    for own, (sizes, _, _), low in zip(used, given, smallest_ids(given), strict=True):
        for k, x in zip(own, np.split(low, np.cumsum(sizes - LENGTH + 1)[:-1]), strict=True):
            found[k] = x
    return [pack(np.concatenate([found[k] for k in place])) for place in where]


# The end: the bytes that go.
def removed(row: dict, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, mask of the removed bytes) of a chunk, from the answers to all steps."""
    chunk, ids, some, entry, several, smallest, pick, spread, counts, begin, string, merged = _to_merge(row)
    data, offsets, start, end, _, owner = chunk
    goes = np.zeros(len(data) + 1, np.int32)
    # Anchors with one window: all its strings have the same smallest id.
    plain = some[~several[entry] & (smallest[entry] < ids[owner[some]])] if len(some) else some
    np.add.at(goes, start[plain], 1)
    np.subtract.at(goes, end[plain], 1)
    # The others: a smallest id for each string.
    answers = _told(row, "answers2", count)
    if len(pick) and answers:
        low = np.concatenate([a[0] for a in answers])
        sizes = end - start - LENGTH + 1
        lengths = merged[0][2] - merged[0][1] - LENGTH + 1
        base = np.full(len(several), -1, np.int64)
        base[pick] = np.cumsum(lengths) - lengths
        ours = some[several[entry]]
        n = sizes[ours]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = low[np.repeat(base[entry[several[entry]]], n) + step] < np.repeat(ids[owner[ours]], n)
        at = (np.repeat(start[ours], n) + step)[hit]
        np.add.at(goes, at, 1)
        np.subtract.at(goes, at + LENGTH, 1)
    answers = _told(row, "answers2", count, count)
    if len(begin) and answers:
        low = np.concatenate([a[0] for a in answers])[string]
        at = begin[low < np.repeat(ids[owner[spread]], counts)]
        np.add.at(goes, at, 1)
        np.subtract.at(goes, at + LENGTH, 1)
    return data, offsets, np.cumsum(goes[:-1]) > 0


class Repeats:
    """All exchanges for the repeated strings of docs; `chunks` is the table with their answers."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, chunk_bytes: int | None = None, keep: list[str] | None = None):
        """keep: further columns that each chunk carries in `rest`, for `cut`."""
        keep = keep or []

        def make(batches: list[pa.RecordBatch]) -> dict:
            texts, lengths, start, size, ahead, base = [], [], [], [], [], 0
            for b in pieces(iter(batches), text_col, PIECE_BYTES):
                data, offsets = flat_bytes(b.column(1))
                s, e, a = windows(data, offsets)
                start.append(s + base)
                size.append(e - s)
                ahead.append(a - s)
                lengths.append(np.diff(offsets))
                texts.append(data)
                base += len(data)
            ids = pa.chunked_array([b.column(0).cast(pa.int64()) for b in batches]).combine_chunks()
            rest = pa.Table.from_batches([b.select(list(range(2, b.num_columns))) for b in batches]) if keep else None
            made = {"ids": pack_ids(ids), "n_bytes": base, "text": zstandard.ZstdCompressor(level=3).compress(np.concatenate(texts).tobytes())}
            made["windows"] = pack(small(np.concatenate(lengths)), small(deltas(np.concatenate(start))), np.concatenate(size).astype(np.uint8), np.concatenate(ahead).astype(np.uint8), level=3)
            made["rest"] = _table_bytes(rest) if rest is not None else None
            return made

        fields = "ids binary, n_bytes long, text binary, windows binary, rest binary"
        columns = [id_col, text_col, *keep]
        self.store = Chunks(docs, text_col, make, fields, columns, **({"limit": chunk_bytes} if chunk_bytes else {}))
        total = self.store.total("n_bytes")
        first = range_count(total, RANGE_BYTES * growth(docs))
        self.ranges = range_count(total, WINDOW_BYTES * growth(docs, 2.0))
        base = self.store.table.select("chunk", "ids", "text", "windows")
        step1 = exchange(base.mapInArrow(sender(_send_anchors(first)), SENT), _answer_anchors(hot)).checkpoint()
        step2 = exchange(self._rows(step1).mapInArrow(sender(_send_variants(first)), SENT), _answer_variants).checkpoint()
        step3 = exchange(self._rows(step1, step2).mapInArrow(sender(_send_windows(self.ranges)), SENT), _answer_windows)
        self.rows = self.store.with_answers(step1, step2, step3)

    def _rows(self, *answers: DataFrame) -> DataFrame:
        return self.store.with_answers(*answers).select("chunk", "ids", "text", "windows", *(f"answers{k}" for k in range(len(answers))))


def _table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, chunk_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every whole text."""
    found = Repeats(docs, id_col, text_col, hot, chunk_bytes)
    count = found.ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                data, offsets, gone = removed(row, count)
                edges = gone.copy()
                edges[1:] &= ~gone[:-1]
                if len(edges):
                    inner = offsets[:-1][offsets[:-1] < len(gone)]
                    edges[inner] = gone[inner]
                sums, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edges)])
                kept, at = data[~gone].tobytes(), offsets - sums[offsets]
                digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([unpack_ids(row["ids"]), pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets])), pa.array(np.diff(spans[offsets])), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)[id_col]
    rows = found.rows.select("ids", "text", "windows", "answers0", "answers1", "answers2")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", F.col("doc_id").cast(kind))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of the text; a character that goes in part stays whole. Same columns.

    chars_col, if docs has it, becomes the length of the new text; a null text stays null.
    """
    keep = [c for c in docs.columns if c not in (id_col, text_col)]
    marked = docs.withColumn("__null", F.col(text_col).isNull())
    found = Repeats(marked, id_col, text_col, keep=[*keep, "__null"])
    count, names = found.ranges, docs.columns
    id_kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                data, offsets, gone = removed(row, count)
                # A byte goes only with its whole character.
                head = np.flatnonzero((data & 0xC0) != 0x80)
                if len(head):
                    whole = np.logical_and.reduceat(gone, head)
                    gone = np.repeat(whole, np.diff(np.append(head, len(data))))
                kept, at = data[~gone].tobytes(), offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]
                rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                nulls = rest.column("__null").to_pylist()
                texts = [None if n else kept[a:b].decode() for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), nulls, strict=True)]
                made = {c: rest.column(c).combine_chunks() for c in keep} | {id_col: unpack_ids(row["ids"]), text_col: pa.array(texts, pa.string())}
                if chars_col in keep:
                    made[chars_col] = pa.array([None if t is None else len(t) for t in texts], made[chars_col].type)
                yield pa.RecordBatch.from_arrays([made[c] for c in names], names=names)

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField(f.name, LongType() if f.name == id_col else f.dataType) for f in docs.schema])
    rows = found.rows.select("ids", "text", "windows", "rest", "answers0", "answers1", "answers2")
    return rows.mapInArrow(run, schema).withColumn(id_col, F.col(id_col).cast(id_kind))
