"""Pixel arithmetic as built-in expressions (M1, M2, M5-M8)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_factor(u: int) -> float:
    """C(u) of the cosine transform: 1 / sqrt 2 for u = 0, else 1 (M2)."""
    return 1 / math.sqrt(2) if u == 0 else 1.0


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255))


def to_sample(x: Column) -> Column:
    """A level-shifted value as a sample: rounded half up and clamped to 0..255."""
    return clamp(F.floor(x + 0.5)).cast("int")


# The conversion's weights of ITU-T T.871, and single-precision weights for gray.
def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """struct<r,g,b> in doubles, not yet rounded or clamped (M6)."""
    b, r = cb - 128, cr - 128
    return F.struct((y + 1.402 * r).alias("r"), (y - 0.344136 * b - 0.714136 * r).alias("g"), (y + 1.772 * b).alias("b"))


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    """Gray 0..255: single-precision weights and a truncating cast (M8)."""
    f = lambda x: F.lit(x).cast("float")
    one = lambda c: c.cast("float")
    return (one(r) * f(0.29891) + one(g) * f(0.58661) + one(b) * f(0.11448)).cast("int")


def rgba_planes(values: Column, n: Column) -> Column:
    """struct of the planes r, g and b of interleaved RGBA values with n pixels (M7)."""
    plane = lambda k: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, i * 4 + k))
    return F.struct(plane(0).alias("r"), plane(1).alias("g"), plane(2).alias("b"))


def gray_rgba(values: Column, n: Column) -> Column:
    """Interleaved RGBA values made gray: Y, Y, Y, 255 for each of n pixels (M8)."""
    gray = lambda i: rgb_to_gray(F.get(values, i * 4), F.get(values, i * 4 + 1), F.get(values, i * 4 + 2))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(gray(i), gray(i), gray(i), F.lit(255))))
