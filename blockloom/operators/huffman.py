"""Huffman codes (C1, C2, A8) and the entropy decoder.

Codes are canonical: a running sum over a table's symbols in order. The decoder is the one
operator that built-in expressions cannot give, as each code's place depends on the one before; it runs over restart intervals in Arrow batches, and
emits whole blocks. Intervals are independent, so many of like length are decoded side by side, a symbol of each at a time; a few, or one
far longer than the others, are decoded one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def code_lengths(tables: DataFrame) -> DataFrame:
    """image_id, class, dest, ord, sym and len: one row per symbol, from the counts per length."""
    lengths = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.array_repeat(k, F.get("counts", k - 1))))
    pairs = F.arrays_zip(lengths.alias("len"), F.col("symbols").alias("sym"))
    trimmed = F.slice(pairs, F.lit(1), F.least(F.size(lengths), F.size("symbols")))
    rows = tables.select("image_id", "class", "dest", F.posexplode(trimmed).alias("ord", "p"))
    return rows.select("image_id", "class", "dest", "ord", "p.sym", "p.len")


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """lengths with `code`: the sum of 2**-len of all symbols before, as a number of len bits."""
    before = Window.partitionBy("image_id", "class", "dest").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.expr("shiftleft(1L, 16 - len)")).over(before), F.lit(0))
    return lengths.withColumn("__used", used).withColumn("code", F.expr("shiftright(__used, 16 - len)")).drop("__used")


def code_text(code: str = "code", length: str = "len"):
    """A code as its bits."""
    return F.lpad(F.bin(F.col(code)), F.col(length), "0")


class Table:
    """For each 16-bit look-ahead: the symbol and its code's length (0: no code)."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.symbol, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        at = done = 0
        for bits, n in enumerate(counts, 1):
            for symbol in symbols[done : done + n]:
                span = 1 << (16 - bits)
                if at + span > 1 << 16:
                    raise ValueError("bad_huffman_table")
                self.symbol[at : at + span], self.length[at : at + span] = symbol, bits
                at += span
            done += n
        self._lists: tuple[list[int], list[int]] | None = None

    @property
    def lists(self) -> tuple[list[int], list[int]]:
        """Symbols and lengths for one look-ahead at a time."""
        if self._lists is None:
            self._lists = self.symbol.tolist(), self.length.tolist()
        return self._lists


#: What follows an interval's data: a block that begins in the data ends in it, and is damaged.
PADDING = b"\xff" * 256


def decode_interval(data: bytes, plan: list[tuple[int, Table, Table]], units: int) -> np.ndarray:
    """The coefficients (zig-zag order, DC undone) of `units` MCUs of destuffed data, a block a row; ValueError if they are not there.

    plan: for each block of an MCU the component's index and its DC and AC tables. A length of exactly what each
    code and its magnitude take is consumed (Q8, Q10).
    """
    end = 8 * len(data)
    data = data + PADDING
    plan = [(c, *dc.lists, *ac.lists) for c, dc, ac in plan]
    pos, last = 0, {c: 0 for c, *_ in plan}
    out, done = [], []
    for _ in range(units):
        if len(out) >= 4096:
            done.append(np.array(out, np.int32))
            out = []
        for component, dc_symbols, dc_lengths, ac_symbols, ac_lengths in plan:
            block = [0] * 64
            word = int.from_bytes(data[pos >> 3 : (pos >> 3) + 5]) >> (24 - (pos & 7))
            n = dc_lengths[word & 0xFFFF]
            size = dc_symbols[word & 0xFFFF]
            if not n or size > 11:
                raise ValueError("truncated_scan" if pos + 16 > end else "bad_code")
            pos += n
            if size:
                value = (int.from_bytes(data[pos >> 3 : (pos >> 3) + 5]) >> (40 - (pos & 7) - size)) & ((1 << size) - 1)
                pos += size
                last[component] += value if value >> (size - 1) else value - (1 << size) + 1
            block[0] = last[component]
            k = 1
            while k < 64:
                word = int.from_bytes(data[pos >> 3 : (pos >> 3) + 5]) >> (24 - (pos & 7))
                n = ac_lengths[word & 0xFFFF]
                if not n:
                    raise ValueError("truncated_scan" if pos + 16 > end else "bad_code")
                pos += n
                symbol = ac_symbols[word & 0xFFFF]
                run, size = symbol >> 4, symbol & 15
                if not size:
                    if run != 15:
                        break
                    k += 16
                    continue
                k += run
                if k > 63 or size > 10:
                    raise ValueError("truncated_scan" if pos > end else "bad_run")
                value = (int.from_bytes(data[pos >> 3 : (pos >> 3) + 5]) >> (40 - (pos & 7) - size)) & ((1 << size) - 1)
                pos += size
                block[k] = value if value >> (size - 1) else value - (1 << size) + 1
                k += 1
            if pos > end:
                raise ValueError("truncated_scan")
            out.append(block)
    return np.concatenate([*done, np.array(out, np.int32).reshape(-1, 64)])


_tables: dict[tuple, Table] = {}


def _table(counts: list[int], symbols: list[int]) -> Table:
    key = (tuple(counts), tuple(symbols))
    if key not in _tables:
        if len(_tables) > 256:
            _tables.clear()
        _tables[key] = Table(counts, symbols)
    return _tables[key]


_CODES = "struct<class:int,dest:int,counts:array<int>,symbols:array<int>>"
PARTS = f"array<struct<comp:int,h:int,v:int,up_h:int,up_v:int,q:array<int>,dc:{_CODES},ac:{_CODES}>>"
#: Geometry that the blocks carry on, so that raster assembly needs no join.
GEOMETRY = "width int, height int, h_max int, v_max int, comps int"
INTERVAL = f"image_id string, first_mcu int, mcus int, mcus_across int, {GEOMETRY}, parts {PARTS}, data binary"
COLUMNS = [f.split()[0] for f in INTERVAL.replace(PARTS, "x").split(", ")]
BLOCK = f"image_id string, comp int, block_y int, block_x int, coef array<int>, q array<int>, up_h int, up_v int, {GEOMETRY}, error string"


def _plan(row: dict) -> list[tuple[int, Table, Table]]:
    plan = []
    for part in row["parts"]:
        if not part["dc"] or not part["ac"]:
            raise ValueError("missing_huffman_table")
        dc, ac = (_table(part[k]["counts"], part[k]["symbols"]) for k in ("dc", "ac"))
        plan += [(part["comp"], dc, ac)] * (part["v"] * part["h"])
    return plan


#: Intervals are decoded side by side if they are as good as so many of the longest's length.
LANES = 24


def decode_lanes(data: list[bytes], plans: list[list[tuple[int, Table, Table]]], units: list[int]) -> list[np.ndarray | ValueError]:
    """decode_interval() of many intervals, a symbol of each in every step."""
    tables = list({id(t): t for plan in plans for _, *own in plan for t in own}.values())
    number = {id(t): k for k, t in enumerate(tables)}
    symbols, lengths = np.stack([t.symbol for t in tables]), np.stack([t.length for t in tables])
    width = max(map(len, plans))
    shaped = lambda pick: np.array([[pick(x) for x in (plan * width)[:width]] for plan in plans])
    component, dc, ac = shaped(lambda x: x[0]), shaped(lambda x: number[id(x[1])]), shaped(lambda x: number[id(x[2])])
    each = np.array([len(p) for p in plans])
    total = each * np.array(units)
    flat = b"".join(d + PADDING for d in data)
    eights = np.ndarray(len(flat) - 7, ">u8", flat, strides=(1,))
    sizes = np.array([len(d) + len(PADDING) for d in data])
    pos = 8 * (np.cumsum(sizes) - sizes)
    end = pos + 8 * (sizes - len(PADDING))
    first = np.cumsum(total) - total
    out = np.zeros((int(total.sum()), 64), np.int32)
    last = np.zeros((len(data), int(component.max(initial=0)) + 1), np.int64)
    block, k = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    wrong: dict[int, str] = {}
    lane = np.flatnonzero(total > 0)
    one = np.uint64(1)
    while len(lane):
        own, at, bit = k[lane], pos[lane], (pos[lane] & 7).astype(np.uint64)
        slot = block[lane] % each[lane]
        head = own == 0
        table = np.where(head, dc[lane, slot], ac[lane, slot])
        word = eights[at >> 3].astype(np.uint64) << bit
        look = (word >> np.uint64(48)).astype(np.int64)
        n, symbol = lengths[table, look].astype(np.int64), symbols[table, look].astype(np.int64)
        size, run = np.where(head, symbol, symbol & 15), np.where(head, 0, symbol >> 4)
        some = size.astype(np.uint64)
        extra = ((word << n.astype(np.uint64)) >> one) >> (np.uint64(63) - some)
        value = extra.astype(np.int64)
        value = np.where((value >> np.maximum(size - 1, 0)) & 1 | (size == 0), value, value - (1 << size) + 1)
        bad = (n == 0) | head & (size > 11)
        at = at + np.where(bad, 0, n)
        place = own + run
        long = ~bad & ~head & (size > 0) & ((place > 63) | (size > 10))
        after = at + np.where(bad | long, 0, size)
        good = ~(bad | long)
        put = good & (head | (size > 0))
        rows = lane[put]
        heads = head[put]
        values = value[put]
        last[rows[heads], component[rows[heads], slot[put][heads]]] += values[heads]
        values[heads] = last[rows[heads], component[rows[heads], slot[put][heads]]]
        out[first[rows] + block[rows], place[put]] = values
        place = np.where(head, 1, np.where(size > 0, place + 1, np.where(run == 15, own + 16, 64)))
        done = good & (place >= 64)
        for i in np.flatnonzero(bad | long | done & (after > end[lane])).tolist():
            name = "truncated_scan" if done[i] or at[i] + (16 if bad[i] else 0) > end[lane[i]] else "bad_code" if bad[i] else "bad_run"
            wrong[int(lane[i])] = name
            good[i] = False
        pos[lane], k[lane] = after, np.where(done, 0, place)
        block[lane] += done
        lane = lane[good & (block[lane] < total[lane])]
    return [ValueError(wrong[i]) if i in wrong else out[first[i] : first[i] + total[i]] for i in range(len(data))]


def decode_rows(rows: list[dict]) -> list[np.ndarray | ValueError]:
    """For each interval (a row of INTERVAL) its coefficients, MCU by MCU, in each part by part and row by row (Q11), or the damage."""
    out: list[np.ndarray | ValueError] = [ValueError()] * len(rows)
    plans: dict[int, list] = {}
    for i, row in enumerate(rows):
        try:
            plans[i] = _plan(row)
        except ValueError as e:
            out[i] = e
    order = sorted(plans, key=lambda i: len(rows[i]["data"]))
    while order:  # the shortest together, as long as they are as good as LANES of the longest
        sizes = np.array([len(rows[i]["data"]) + 1 for i in order])
        enough = np.flatnonzero(np.cumsum(sizes) >= LANES * sizes)
        if len(enough):
            own, order = order[: enough[-1] + 1], order[enough[-1] + 1 :]
            found = decode_lanes([rows[i]["data"] for i in own], [plans[i] for i in own], [rows[i]["mcus"] for i in own])
            for i, x in zip(own, found, strict=True):
                out[i] = x
            continue
        for i in order:
            try:
                out[i] = decode_interval(rows[i]["data"], plans[i], rows[i]["mcus"])
            except ValueError as e:
                out[i] = e
        break
    return out


#: Bytes of data that are decoded at once, unless an interval is longer.
AT_ONCE = 2 << 20


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray | ValueError]]:
    """Each interval of the batches with what decode_rows makes of it."""
    for batch in batches:
        for part in pieces(batch, "data", AT_ONCE):
            rows = part.to_pylist()
            yield from zip(rows, decode_rows(rows), strict=True)


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `limit` bytes in `column`, and 1,024 rows; a longer value is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))), start + 1024)
        yield batch.slice(start, stop - start)
        start = stop


def places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, block_y, block_x) of each block of an interval."""
    one = np.array([(k, p["v"], y, p["h"], x) for k, p in enumerate(row["parts"]) for y in range(p["v"]) for x in range(p["h"])], np.int64).reshape(-1, 5)
    unit = np.repeat(np.arange(row["mcus"]) + row["first_mcu"], len(one))
    where, across = np.tile(one, (row["mcus"], 1)), row["mcus_across"]
    return where[:, 0], unit // across * where[:, 1] + where[:, 2], unit % across * where[:, 3] + where[:, 4]


def decode(intervals: DataFrame) -> DataFrame:
    """The columns of BLOCK for every block; a damaged interval gives one row with `error` instead.

    intervals: the columns of INTERVAL. A component has h by v blocks in each MCU; up_h and up_v say how
    far its samples are spread. Rows come out interval by interval, so memory is bounded by an interval.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, blocks in decoded(batches):
            yield _block_rows(row, blocks)

    return intervals.select(*COLUMNS).mapInArrow(run, BLOCK)


def errors(intervals: DataFrame) -> DataFrame:
    """image_id and error of every damaged interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, blocks in decoded(batches):
            if isinstance(blocks, ValueError):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (row["image_id"], str(blocks))], names=["image_id", "error"])

    return intervals.select(*COLUMNS).mapInArrow(run, "image_id string, error string")


def _block_rows(row: dict, blocks: np.ndarray | ValueError) -> pa.RecordBatch:
    int32, array = pa.int32(), pa.list_(pa.int32())
    schema = pa.schema([("image_id", pa.string()), ("comp", int32), ("block_y", int32), ("block_x", int32), ("coef", array), ("q", array), ("up_h", int32), ("up_v", int32), ("width", int32), ("height", int32), ("h_max", int32), ("v_max", int32), ("comps", int32), ("error", pa.string())])
    if isinstance(blocks, ValueError):
        return pa.RecordBatch.from_pylist([{"image_id": row["image_id"], "error": str(blocks)}], schema=schema)
    part, block_y, block_x = places(row)
    n = len(blocks)
    of_part = lambda key: np.array([p[key] for p in row["parts"]], np.int32)[part]
    lists = lambda flat: pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64), int32), pa.array(flat.astype(np.int32).ravel()))
    made = {
        "image_id": pa.array([row["image_id"]] * n, pa.string()), "comp": of_part("comp"), "block_y": block_y, "block_x": block_x,
        "coef": lists(blocks), "q": lists(np.array([p["q"] for p in row["parts"]])[part]), "up_h": of_part("up_h"), "up_v": of_part("up_v"), "error": pa.nulls(n, pa.string()),
    } | {k: np.full(n, row[k], np.int32) for k in ("width", "height", "h_max", "v_max", "comps")}
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [made[f.name]]], schema=schema)
