"""A baseline encoder for blocks of coefficients: round-trip tests and a sink for small gray images.

Fixed values: the Huffman tables of ITU-T T.81 Annex K.3, tables K.3 to K.6, and the quantization table K.1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of ITU-T T.81 Annex K: counts of codes of 1..16 bits, and symbols in code order.
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    list(
        bytes.fromhex(
            "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
            "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
            "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
        )
    ),
)
# Fixed values of ITU-T T.81 Table K.1, in natural order.
QUANT_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]


def codes(table: tuple[list[int], list[int]]) -> dict[int, str]:
    """symbol -> its canonical code's bits."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(table[0], 1):
        for symbol in table[1][at : at + n]:
            out[symbol] = format(code, f"0{bits}b")
            code += 1
        at += n
        code <<= 1
    return out


_DC, _AC = codes(DC_LUMA), codes(AC_LUMA)


def _magnitude(value: int) -> tuple[int, str]:
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def entropy(blocks: list[list[int]], restart: int = 0, plan: tuple[int, ...] = (0,)) -> bytes:
    """The stuffed data of blocks (zig-zag order, MCU by MCU), with a restart marker after every `restart` MCUs.

    plan: the component of each block of an MCU.
    """
    out, bits, last = bytearray(), [], dict.fromkeys(plan, 0)

    def flush() -> None:
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        for i in range(0, len(text), 8):
            out.append(int(text[i : i + 8], 2))
            if out[-1] == 0xFF:
                out.append(0)
        bits.clear()

    for k, block in enumerate(blocks):
        unit, place = divmod(k, len(plan))
        if restart and unit and not place and unit % restart == 0:
            flush()
            out.extend((0xFF, 0xD0 + (unit // restart - 1) % 8))
            last = dict.fromkeys(plan, 0)
        size, extra = _magnitude(block[0] - last[plan[place]])
        bits.append(_DC[size] + extra)
        last[plan[place]], run = block[0], 0
        for value in block[1:]:
            if not value:
                run += 1
                continue
            while run > 15:
                bits.append(_AC[0xF0])
                run -= 16
            size, extra = _magnitude(value)
            bits.append(_AC[run << 4 | size] + extra)
            run = 0
        if run:
            bits.append(_AC[0])
    flush()
    return bytes(out)


def segment(code: int, payload: bytes) -> bytes:
    return bytes((0xFF, code)) + (len(payload) + 2).to_bytes(2) + payload


def _head(width: int, height: int, quant: list[int], factors: list[tuple[int, int]], restart: int) -> bytes:
    """All before the scans: one quantization table (zig-zag order), the frame, the luma Huffman tables."""
    dht = lambda kind, t: segment(0xC4, bytes([kind, *t[0], *t[1]]))
    frame = bytes([8]) + height.to_bytes(2) + width.to_bytes(2) + bytes([len(factors), *(x for k, (h, v) in enumerate(factors, 1) for x in (k, h << 4 | v, 0))])
    parts = [b"\xff\xd8", segment(0xDB, bytes([0, *quant])), segment(0xC0, frame), dht(0x00, DC_LUMA), dht(0x10, AC_LUMA)]
    return b"".join([*parts, segment(0xDD, restart.to_bytes(2))] if restart else parts)


def _scan(components: list[int], data: bytes) -> bytes:
    return segment(0xDA, bytes([len(components), *(x for c in components for x in (c, 0)), 0, 63, 0])) + data


def gray_image(blocks: list[list[int]], width: int, height: int, quant: list[int], restart: int = 0) -> bytes:
    """A gray stream of blocks (zig-zag order, row by row) with a quantization table in zig-zag order."""
    return _head(width, height, quant, [(1, 1)], restart) + _scan([1], entropy(blocks, restart)) + b"\xff\xd9"


def color_image(blocks: list[list[int]], width: int, height: int, quant: list[int], factors: list[tuple[int, int]], restart: int = 0) -> bytes:
    """An interleaved stream of blocks, MCU by MCU; factors: (h, v) of each component."""
    plan = tuple(k for k, (h, v) in enumerate(factors) for _ in range(h * v))
    return _head(width, height, quant, factors, restart) + _scan(list(range(1, len(factors) + 1)), entropy(blocks, restart, plan)) + b"\xff\xd9"


def separate_scans(blocks: list[list[list[int]]], width: int, height: int, quant: list[int]) -> list[bytes]:
    """The pieces of a stream without subsampling: the head, and a scan for each component's blocks."""
    return [_head(width, height, quant, [(1, 1)] * len(blocks), 0), *(_scan([k], entropy(own)) for k, own in enumerate(blocks, 1))]


def encode_blocks(rows: DataFrame, id_col: str, coef_col: str, quant: list[int]) -> DataFrame:
    """image_id and content: each row's 64 coefficients (zig-zag order) as a gray image of 8 by 8 pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [gray_image([np.array(c).tolist()], 8, 8, quant) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["image_id", "content"])

    return rows.select(id_col, coef_col).mapInArrow(run, "image_id string, content binary")


def encode_rows(rows: DataFrame, id_col: str, blocks_col: str, make, schema: str) -> DataFrame:
    """image_id and the columns of schema: `make` of each row's blocks (arrays of 64 coefficients) returns their values."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(b) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), *(pa.array([m[k] for m in made], pa.binary()) for k in range(len(names)))], names=["image_id", *names])

    return rows.select(id_col, blocks_col).mapInArrow(run, f"image_id string, {schema}")
