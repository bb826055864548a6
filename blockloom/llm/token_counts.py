"""Operator 10: token counts by compiled finite-state transducers.

The byte-level BPE tokenizer is compiled, from its file alone, into two deterministic machines.

The *boundary transducer* reads character classes and marks where pretokens begin. A text is cut into blocks of `BLOCK`
characters. For each block the transducer is run from every state at once, which gives the block's state map; the maps are composed
by a parallel prefix scan (doubling), and each block is run again from the state that the scan found.

The *merge transducer* reads a pretoken's bytes. After each byte it knows the last token of what it has read and has emitted
as many tokens as that has: a transition's annotation is the change of that number, which can be negative, and a
pretoken's count is their sum. The last token is the one token t that ends there and may follow the last token of what is before t:
two tokens may be neighbours if no merge across their border would have come before the merges that made them, and a text's
tokens are the one sequence of such neighbours. Which tokens end at a place is the state of an automaton over all tokens; which may be neighbours
is compiled on first use. Many pretokens are read side by side, each distinct one once; a machine keeps up to ARCS of them, compared by
all their bytes, with their counts.

Defined results: a null text counts as empty (0 tokens); an empty table gives an empty result; rows
with equal doc_id are counted separately; columns beyond the two named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tables import pieces
from .text import Spans, code_points, flat_bytes

BLOCK = 64
ARCS = 4_000_000
#: Pretokens of more bytes are read one by one.
LONG = 256
# States: 0 a pretoken has ended (or none began), then runs of letters, numbers, other signs, white space that ends
# in a space, white space that ends otherwise, an apostrophe that begins a pretoken, 're/'ve and 'll half read.
END, LETTERS, NUMBERS, SIGNS, SPACE, WHITE, APOSTROPHE, HALF_E, HALF_L = range(9)
# Classes: letters s t m d, letters r v, letter e, letter l, other letters, numbers, space, other white space,
# apostrophe, other signs, end of a text.
C_STMD, C_RV, C_E, C_L, C_LETTER, C_NUMBER, C_SPACE, C_WHITE, C_APOSTROPHE, C_SIGN, C_STOP = range(11)
STARTS_HERE, STARTS_BEFORE = 16, 32


def _step(state: int, kind: int) -> int:
    """Next state, with the marks: a pretoken starts at this character, or at the one before."""
    if state in (HALF_E, HALF_L):
        if kind == (C_E if state == HALF_E else C_L):
            return END
        return _step(LETTERS, kind) | STARTS_BEFORE
    if kind == C_STOP:
        return END
    letter = kind <= C_LETTER
    run = LETTERS if letter else {C_NUMBER: NUMBERS, C_SPACE: SPACE, C_WHITE: WHITE}.get(kind, SIGNS)
    if kind in (C_SPACE, C_WHITE):
        return run if state in (SPACE, WHITE) else run | STARTS_HERE
    if state == SPACE:
        return run | STARTS_BEFORE
    if state == APOSTROPHE:
        if kind == C_STMD:
            return END
        if kind in (C_RV, C_L):
            return HALF_E if kind == C_RV else HALF_L
        return SIGNS if run == SIGNS else run | STARTS_HERE
    if state == run:
        return run
    marks = STARTS_HERE | (STARTS_BEFORE if state == WHITE else 0)
    return (APOSTROPHE if kind == C_APOSTROPHE else run) | marks


STEP = np.array([[_step(s, c) for c in range(11)] for s in range(9)], np.uint8)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, after the Unicode properties in the tokenizer's own pattern."""
    if not _classes:
        table = np.full(0x110000, C_SIGN, np.uint8)
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        everything = "".join(map(chr, points))
        for pattern, kind in ((r"\p{L}+", C_LETTER), (r"\p{N}+", C_NUMBER), (r"\s+", C_WHITE)):
            for m in regex.finditer(pattern, everything):
                table[points[m.start()] : points[m.end() - 1] + 1] = kind
        for letters, kind in (("stmd", C_STMD), ("rv", C_RV), ("e", C_E), ("l", C_L), (" ", C_SPACE), ("'", C_APOSTROPHE)):
            for x in letters:
                table[ord(x)] = kind
        _classes.append(table)
    return _classes[0]


def run_transducer(kinds: np.ndarray) -> np.ndarray:
    """True where a pretoken starts, for one sequence of classes with a C_STOP after each text."""
    n = len(kinds)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, C_STOP, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    flat = (STEP & 15).ravel()
    maps = np.tile(np.arange(9, dtype=np.uint8)[:, None], (1, rows))
    for column in columns:  # the state map of every block
        maps = flat[maps * np.uint8(11) + column]
    step = 1
    while step < rows:  # inclusive scan by doubling: maps[:, i] composes blocks 0..i
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].copy(), axis=0)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[END, :-1]
    marks = np.empty((BLOCK, rows), np.uint8)
    flat = STEP.ravel()
    for i, column in enumerate(columns):
        marks[i] = flat[state * np.uint8(11) + column]
        state = marks[i] & 15
    marks = marks.T.ravel()[:n]
    starts = (marks & STARTS_HERE) != 0
    starts[:-1] |= (marks[1:] & STARTS_BEFORE) != 0
    return starts


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """The merge transducer. Tokens are numbered: bytes, then merges by rank from 256 on."""

    NEVER = 1 << 40

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        number = {bytes([b]): b for b in range(256)}
        self.left, self.right = np.full(256 + len(merges), -1), np.full(256 + len(merges), -1)
        for k, (a, b) in enumerate(merges, 256):
            if a not in number or b not in number or a + b in number:
                raise ValueError("a merge of tokens that no earlier merge makes, or a second one to the same token")
            self.left[k], self.right[k] = number[a], number[b]
            number[a + b] = k
        self.length = np.array([len(t) for t in number], np.int64)
        key = self._pair(self.left[256:], self.right[256:])
        order = np.argsort(key)
        self.merge_keys, self.merge_ranks = key[order], order + 256
        # A token that its own bytes don't come to is in no text.
        reached = np.ones(len(number), bool)
        reached[256:] = ~self.crosses(self.left[256:], self.right[256:], np.arange(256, len(number)))
        for k in range(256, len(number)):
            reached[k] &= reached[self.left[k]] and reached[self.right[k]]
        self._automaton([t for t, ok in zip(number, reached.tolist(), strict=True) if ok], np.flatnonzero(reached))
        self.met, self.meets = np.empty(0, np.int64), np.empty(0, bool)
        self.known: dict[int, bool] = {}

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << 32 | b.astype(np.int64)

    def crosses(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether a merge across the border of tokens a and b comes before those that make them, and before `until`.

        The last part of a and the first part of b change as their own merges are done; each pair of such parts that are there
        at one time may merge. Of equal merges the left one comes first.
        """
        out = np.zeros(len(a), bool)
        until = np.broadcast_to(np.asarray(until, np.int64), (len(a),))
        some, x, x_until = np.arange(len(a)), a.astype(np.int64), until
        while len(some):
            own, y, y_until = some, b[some].astype(np.int64), until[some]
            part, part_until = x, x_until
            while len(own):
                key = self._pair(part, y)
                at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1) if len(self.merge_keys) else np.zeros(len(key), np.int64)
                rank = np.where(self.merge_keys[at] == key, self.merge_ranks[at], self.NEVER) if len(self.merge_keys) else np.full(len(key), self.NEVER)
                out[own[(rank < part_until) & (rank <= y_until) & (rank < until[own])]] = True
                deeper = (y >= 256) & ~out[own]
                own, part, part_until, y_until, y = own[deeper], part[deeper], part_until[deeper], y[deeper], self.left[y[deeper]]
            deeper = (x >= 256) & ~out[some]
            some, x_until, x = some[deeper], x[deeper], self.right[x[deeper]]
        return out

    def _automaton(self, tokens: list[bytes], ids: np.ndarray) -> None:
        """goto[row[node], byte], the longest token that ends at a node, and for a token the next shorter one that ends with it.

        A node that no token goes on from goes where its link goes, and shares its row.
        """
        nodes: dict[bytes, int] = {b"": 0}
        for t in tokens:
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes))
        names = list(nodes)
        depth = np.array([len(x) for x in names])
        parent = np.array([nodes[x[:-1]] if x else 0 for x in names])
        byte = np.array([x[-1] if x else 0 for x in names])
        inner = np.zeros(len(names), bool)
        inner[parent] = True
        self.row = np.cumsum(inner, dtype=np.int32) - 1
        self.goto, fail = np.zeros((int(inner.sum()), 256), np.int32), np.zeros(len(names), np.int32)
        own = np.full(len(names), -1)
        own[[nodes[t] for t in tokens]] = ids
        self.longest, self.shorter = np.full(len(names), -1), np.full(len(self.left), -1)
        for d in range(depth.max() + 1):
            level = np.flatnonzero(depth == d)
            if d:
                # The link of a child is where its parent's link goes by the byte; the root's children link to the root.
                fail[level] = self.goto[self.row[fail[parent[level]]], byte[level]] if d > 1 else 0
                self.row[level[~inner[level]]] = self.row[fail[level[~inner[level]]]]
                own_row = level[inner[level]]
                self.goto[self.row[own_row]] = self.goto[self.row[fail[own_row]]]
                below = self.longest[fail[level]]
                self.longest[level] = np.where(own[level] >= 0, own[level], below)
                ends = own[level] >= 0
                self.shorter[own[level][ends]] = below[ends]
            children = np.flatnonzero(depth == d + 1)
            self.goto[self.row[parent[children]], byte[children]] = children

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a; new pairs are compiled."""
        key = self._pair(a, b)
        at = np.searchsorted(self.met, key)
        new = np.ones(len(key), bool)
        inside = at < len(self.met)
        new[inside] = self.met[at[inside]] != key[inside]
        if new.any():
            fresh = np.unique(key[new])
            place = np.searchsorted(self.met, fresh)
            self.met, self.meets = np.insert(self.met, place, fresh), np.insert(self.meets, place, ~self.crosses(fresh >> 32, fresh & 0xFFFFFFFF))
            at = np.searchsorted(self.met, key)
        return self.meets[at]

    def emitted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens that the transducer has emitted at the end of each data[start:end]."""
        size = ends - starts
        out = np.zeros(len(starts), np.int64)
        if len(self.met) > ARCS:
            self.met, self.meets, self.known = self.met[:0], self.meets[:0], {}
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = self._one(data[starts[i] : ends[i]].tobytes())
        some = np.flatnonzero((size > 0) & (size <= LONG))
        some = some[np.argsort(-size[some], kind="stable")]
        size, first = size[some], starts[some]
        width = int(size[0]) + 1 if len(some) else 0
        last, count = np.full((len(some), width), -1, np.int32), np.zeros((len(some), width), np.int32)
        node = np.zeros(len(some), np.int32)
        for k in range(1, width):  # one byte of all pretokens that have it
            n = int(np.searchsorted(-size, -k, side="right"))
            node = self.goto[self.row[node[:n]], data[first[:n] + k - 1]]
            token, open_ = self.longest[node], np.arange(n)
            while len(open_):
                before = k - self.length[token]
                fits = before == 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self.neighbours(last[open_[inner], before[inner]], token[inner])
                done = open_[fits]
                last[done, k], count[done, k] = token[fits], count[done, before[fits]] + 1
                open_, token = open_[~fits], self.shorter[token[~fits]]
        out[some] = count[np.arange(len(some)), size] if len(some) else 0
        return out

    def _one(self, text: bytes) -> int:
        """emitted() of one long pretoken, in memory of four numbers a byte."""
        last, count, node = [-1], [0], 0
        for k, byte in enumerate(text, 1):
            node = self.goto[self.row[node], byte]
            token = int(self.longest[node])
            while (before := k - int(self.length[token])) > 0:
                key = last[before] << 32 | token
                fits = self.known.get(key)
                if fits is None:
                    fits = self.known[key] = bool(self.neighbours(np.array([last[before]]), np.array([token]))[0])
                if fits:
                    break
                token = int(self.shorter[token])
            last.append(token)
            count.append(count[before] + 1)
        return count[-1]


class Transducer:
    """Both machines of one tokenizer file, and the pretokens met so far with their counts; at most ARCS, then begun anew."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, first = said["model"], said["pre_tokenizer"] or {}
        plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or said["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
            raise ValueError("only byte-level BPE files without further settings can be compiled")
        letters = byte_letters()
        spelled = lambda t: bytes(letters[x] for x in t)
        self.merges = Merges([(spelled(a), spelled(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])])
        self.special = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.long: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        # Of pretokens of 16 bytes or less: the hash, the first and the last 8 bytes, the length and the count.
        self.keys, self.head, self.tail = (np.empty(0, np.uint64) for _ in range(3))
        self.size, self.emits = np.empty(0, np.int64), np.empty(0, np.int64)

    def arcs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The emitted tokens of each pretoken data[start:end]."""
        size = ends - starts
        out = np.zeros(len(starts), np.int64)
        some = np.flatnonzero(size <= 16)
        spans = Spans(data)
        keys = spans.hashes(starts[some], ends[some])
        own = np.minimum(size[some], 8)
        head, tail = spans.load(starts[some], own), spans.load(ends[some] - own, own)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.empty(len(ordered), bool)
        first[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
        index = order[first]
        group = np.empty(len(some), np.int64)
        group[order] = np.cumsum(first) - 1
        if len(self.keys) > ARCS:
            self._forget()
        at = np.searchsorted(self.keys, keys[index])
        new = np.ones(len(index), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[index[inside]]
        if new.any():
            fresh, place = index[new], at[new]
            made = self.merges.emitted(data, starts[some[fresh]], ends[some[fresh]])
            for name, values in (("keys", keys), ("head", head), ("tail", tail), ("size", size[some])):
                setattr(self, name, np.insert(getattr(self, name), place, values[fresh]))
            self.emits = np.insert(self.emits, place, made)
        at = np.searchsorted(self.keys, keys[index])[group]
        out[some] = self.emits[at]
        same = (self.head[at] == head) & (self.tail[at] == tail) & (self.size[at] == size[some])
        rest = np.concatenate([some[~same], np.flatnonzero(size > 16)])
        if len(rest):  # long pretokens, and others whose hash another one has
            if len(self.long) > ARCS // 10:
                self.long.clear()
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
            fresh = {t: k for k, t in enumerate(texts) if t not in self.long}
            which = rest[list(fresh.values())]
            self.long.update(zip(fresh, self.merges.emitted(data, starts[which], ends[which]).tolist(), strict=True))
            out[rest] = [self.long[t] for t in texts]
        return out

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row, as the library counts them without added special tokens."""
        n = len(column)
        extra, rows = np.zeros(n, np.int64), np.arange(n)
        import pyarrow.compute as pc

        if self.split is not None:
            has = pc.fill_null(pc.match_substring(column, self.special[0]), False)
            for s in self.special[1:]:
                has = pc.or_(has, pc.fill_null(pc.match_substring(column, s), False))
            if pc.any(has).as_py():  # special strings are cut out and count one token each
                parts, rows = [], []
                for i, text in enumerate(column.to_pylist()):
                    own = self.split.split(text or "")
                    extra[i] = len(own) - 1
                    parts += own
                    rows += [i] * len(own)
                column, rows = pa.array(parts, pa.large_string()), np.array(rows)
        data, offsets = flat_bytes(column)
        if not len(data):
            return extra
        at, points = code_points(data)
        stops = np.searchsorted(at, offsets[1:])
        kinds = np.insert(classes()[points], stops, C_STOP)
        marks = run_transducer(kinds)
        stop_at = stops + np.arange(len(stops))
        keep = np.ones(len(kinds), bool)
        keep[stop_at] = False
        starts = at[marks[keep]]
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(offsets, starts, side="right") - 1
        ends = np.minimum(ends, offsets[row + 1])
        return extra + np.bincount(rows[row], self.arcs(data, starts, ends), n).astype(np.int64)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    `tokenizer` is the name of a byte-level BPE file in the public tokenizers' folder, or a path on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in pieces(batches, text_col):
            tokens = machine.count(batch.column(text_col))
            _, offsets = flat_bytes(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
