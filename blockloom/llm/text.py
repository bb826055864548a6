"""Arrow text columns as flat arrays: bytes, words and word shingles, hashed without Python strings.

A *word* is a maximal run of letters, digits, combining marks and ``_`` of the
lower-cased text, whatever else the batch holds. A word's hash mixes its bytes eight at a time, nonlinearly, so
no family of words has equal hashes by construction; equal words have
equal hashes in every process. A null text counts as the empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_Q = U64(0xC2B2AE3D27D4EB4F | 1)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_ASCII_WORD = np.array([chr(i).isalnum() or chr(i) == "_" or i >= 128 for i in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(P**i, P**-i) modulo 2**64 for i < n at least."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(int(_P), -1, 1 << 64)
        for name, base in (("up", int(_P)), ("down", inverse)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U64(pow(base, done, 1 << 64))
                done *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 row offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        lead, where = points[wide], at[wide]
        n = 1 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (0x3F >> n)
        for k in (1, 2, 3):
            more = n >= k
            value[more] = value[more] << 6 | padded[where[more] + k] & 0x3F
        points[wide] = value
    return at, points


_in_word = np.full(0x110000, 2, np.uint8)  # of a code point: 0 no, 1 yes, 2 not asked yet


def _word_points(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter, digit, combining mark or ``_``."""
    kinds = _in_word[points]
    if (kinds == 2).any():
        new = np.unique(points[kinds == 2])
        _in_word[new] = pc.match_substring_regex(pa.array([chr(x) for x in new.tolist()]), r"^[\pL\pN\pM_]$").to_numpy(zero_copy_only=False)
        kinds = _in_word[points]
    return kinds == 1


def word_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, word mask) of the lower-cased column; a byte's mask is that of its character.

    Bytes of ASCII and of the two-byte letters led by 0xC3 need no look at the characters.
    """
    data, offsets = flat_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    lead = data >= 0xC0
    if lead.any() and (bool((data[lead] != 0xC3).any()) or bool(((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))).any())):
        at, points = code_points(data)
        return data, offsets, np.repeat(_word_points(points), np.diff(np.append(at, len(data))))
    return data, offsets, _ASCII_WORD[data]


class Runs:
    """Mixed polynomial hashes modulo 2**64 of data[start:end] for many pairs; equal contents have equal hashes.

    For short overlapping spans: there are unequal ones of a thousand bytes with equal hashes for any base.
    """

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Runs(data).hashes() for ascending starts and spans of a hundred bytes or less: block by block, in little memory."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + block, block))
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            base = k * block
            out[a:b] = Runs(data[base : int(ends[a:b].max())]).hashes(starts[a:b] - base, ends[a:b] - base)
    return out


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Spans:
    """Hashes of data[start:end] for many pairs, whatever their lengths; equal contents have equal hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def load(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n bytes (0 to 8) at each place as one number."""
        return self.eights[at] & _LOW_BYTES[n]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = size.astype(np.uint64) * _P
        some, k = np.flatnonzero(size <= LONG_SPAN), 0
        while len(some):
            left = size[some] - k
            out[some] = mix((out[some] ^ self.load(starts[some] + k, np.minimum(left, 8))) * _Q + U64(k + 1))
            some, k = some[left > 8], k + 8
        for i in np.flatnonzero(size > LONG_SPAN).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]])
        return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(data).hashes(starts, ends) if len(starts) else np.empty(0, np.uint64)


def words(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows one after another, n + 1 row offsets into them)."""
    hashes, offsets, _, _, _ = words_and_spans(column)
    return hashes, offsets


def words_and_spans(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), with the starts and ends of the words in the lower-cased bytes, and these bytes."""
    data, offsets, mask = word_text(column)
    before = np.empty(len(mask), bool)
    if len(mask):
        before[0] = False
        before[1:] = mask[:-1]
        edges = offsets[:-1][offsets[:-1] < len(mask)]
        before[edges] = False
        after = np.empty(len(mask), bool)
        after[-1] = False
        after[:-1] = mask[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    else:
        after = before
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets), starts, ends, data


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within a row, and the n + 1 row offsets; shorter rows have none."""
    n = len(hashes) - width + 1
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0 or not out_offsets[-1]:
        return np.empty(0, np.uint64), out_offsets
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= _Q
        total += hashes[k : n + k]
    keep = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], counts)
    return mix(total[keep]), out_offsets


def shingles_or_whole(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(); rows of 1 to width - 1 words have one shingle, all their words."""
    found, own = shingles(hashes, offsets, width)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return found, own
    whole = np.array([mix((hashes[a:b] * _Q ** np.arange(b - a, 0, -1, dtype=np.uint64)).sum(keepdims=True))[0] for a, b in zip(offsets[short], offsets[short + 1], strict=True)], np.uint64)
    return np.insert(found, own[short], whole), own + np.concatenate([[0], np.cumsum((counts > 0) & (counts < width))])
