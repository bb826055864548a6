"""

Positions count from 0. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATIN = "ISO-8859-1"


def _i(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row: the optimizer copies no expression through a generator."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    kept = [n for n in df.columns if n not in columns]
    return df.select(*kept, F.explode(F.array(made)).alias("__once")).select(*kept, *(F.col("__once")[n].alias(n) for n in columns))


def hex_int(b: Column) -> Column:
    """The big-endian number that a few bytes spell; null for none."""
    return F.conv(F.hex(b), 16, 10).cast("int")


def slice_bytes(b: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from position `at`."""
    return F.substring(b, _i(at) + 1, _i(n))


def byte_at(b: Column, at: Column | int) -> Column:
    """The byte at a position as 0..255; null beyond the end."""
    return hex_int(slice_bytes(b, at, 1))


def be16(b: Column, at: Column | int) -> Column:
    """The big-endian 16-bit number at a position."""
    return hex_int(slice_bytes(b, at, 2))


def high_nibble(x: Column) -> Column:
    return F.shiftright(x, 4)


def low_nibble(x: Column) -> Column:
    return x.bitwiseAND(F.lit(15))


def byte_bits(x: Column) -> Column:
    """The eight bits of a number 0..255, most significant first (B1)."""
    return F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.getbit(x, k).cast("tinyint"))


def byte_values(b: Column) -> Column:
    """All bytes as an array of 0..255."""
    n = F.octet_length(b)
    empty = F.array().cast("array<int>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: byte_at(b, i))).otherwise(empty)


def bits(b: Column) -> Column:
    """All bits, most significant first (B2). For inspection: the decoder reads packed bytes."""
    return F.flatten(F.transform(byte_values(b), byte_bits))


def from_values(values: Column) -> Column:
    """The BINARY of an array of 0..255."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def latin(b: Column) -> Column:
    """Bytes as a string of one character each, so built-in string search works on them."""
    return F.decode(b, LATIN)


def stuff(b: Column) -> Column:
    """A zero byte after each FF, as entropy-coded data has."""
    return F.encode(F.replace(latin(b), F.lit("\xff"), F.lit("\xff\x00")), LATIN)


def destuff(b: Column) -> Column:
    """The zero byte after each FF taken out, wherever it lies (S8; no chunk border loses one, Q16)."""
    return F.encode(F.replace(latin(b), F.lit("\xff\x00"), F.lit("\xff")), LATIN)


def marker_positions(b: Column) -> Column:
    """(pos, code) of each FF that a byte other than 00 and FF follows, payloads included (S4 raw, F1, F2, Q19-Q21).

    The string is split at FF: no byte is looked at alone, and data without FF costs one scan (F3).
    """
    start = F.struct(F.lit(-1).alias("pos"), F.array().cast("array<struct<pos:int,code:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        found = F.struct(acc["pos"].alias("pos"), F.ascii(part).alias("code"))
        real = (acc["pos"] >= 0) & (F.length(part) > 0) & (F.ascii(part) > 0)
        return F.struct((acc["pos"] + F.length(part) + 1).alias("pos"), F.when(real, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(latin(b), "\xff"), start, step, lambda acc: acc["out"])


def fold(steps: Column | int, start: Column, step: Callable[[Column], Column]) -> Column:
    """Apply `step` to a state `steps` times."""
    return F.aggregate(F.sequence(F.lit(1), _i(steps)), start, lambda acc, _: step(acc))
