"""Coefficient blocks to samples (D3, M1-M5, A5)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import norm_factor


def zigzag() -> list[int]:
    """For each natural position the place in zig-zag order: diagonals in turn, upwards where even."""
    path = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    place = [0] * 64
    for k, p in enumerate(path):
        place[p] = k
    return place


ZIGZAG = zigzag()


def dezigzag(coef: Column) -> Column:
    """Coefficients in natural order: a gather (Q3)."""
    return F.transform(F.array(*map(F.lit, ZIGZAG)), lambda z: F.get(coef, z))


def dequantize(coef: Column, q: Column) -> Column:
    """Products in whole numbers, both in zig-zag order (M1, Q13, Q14)."""
    return F.zip_with(coef, q, lambda c, s: c * s)


def basis(spark: SparkSession) -> DataFrame:
    """p, k and w: the weight of natural coefficient k in sample p, 4,096 rows (M2, M3)."""
    p, k = F.col("id") / 64, F.col("id") % 64
    rows = spark.range(4096).select(p.cast("int").alias("p"), k.cast("int").alias("k"))
    x, y = F.col("p") % 8, (F.col("p") / 8).cast("int")
    u, v = F.col("k") % 8, (F.col("k") / 8).cast("int")
    c = lambda n: F.when(n == 0, norm_factor(0)).otherwise(norm_factor(1))
    wave = lambda a, f: F.cos((a * 2 + 1) * f * F.lit(math.pi) / 16)
    return rows.withColumn("w", c(u) * c(v) / 4 * wave(x, u) * wave(y, v))


def idct_join(coefs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, p and s: samples of long coefficient rows (keys, k, c) by a join to the basis and a sum (M4, A5, Q1, Q2).

    The basis has 4,096 rows at any scale, so it is broadcast; the sum is partially aggregated.
    """
    joined = coefs.join(F.broadcast(basis(coefs.sparkSession)), "k")
    return joined.groupBy(*keys, "p").agg(F.sum(F.col("c") * F.col("w")).alias("s"))


@cache
def basis_matrix() -> np.ndarray:
    """The same weights as a matrix [k, p]."""
    n = np.arange(8)
    wave = np.cos((2 * n[:, None] + 1) * n[None, :] * math.pi / 16) * np.array([norm_factor(int(u)) for u in n]) / 2
    return np.einsum("yv,xu->vuyx", wave, wave).reshape(64, 64)


def samples(coefs: np.ndarray, quants: np.ndarray) -> np.ndarray:
    """Samples 0..255 of blocks [n, 64] in zig-zag order and their tables: D3 and M1 to M5 as one product (Q13, Q14, Q24)."""
    natural = (coefs.astype(np.int64) * quants)[:, ZIGZAG]
    return np.clip(np.floor(natural @ basis_matrix() + 128.5), 0, 255).astype(np.uint8)


def idct(blocks: DataFrame, coef: str = "coef", out: str = "px") -> DataFrame:
    """blocks with `out`, 64 samples before the level shift, by one matrix product per Arrow batch (M4).

    Faster than the join on many blocks (idct and level_shift in bench.py), as no row is exploded or shuffled.
    """
    matrix = basis_matrix()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(coef)
            valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            samples = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64) @ matrix
            offsets = np.zeros(len(batch) + 1, np.int32)
            offsets[1:][valid] = 64
            made = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.array(samples.ravel()), mask=pa.array(~np.isin(np.arange(len(batch)), valid)))
            names = [c for c in batch.schema.names if c != coef]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, out])

    kept = [c for c in blocks.columns if c != coef]
    schema = ", ".join(f"`{n}` {t}" for n, t in blocks.dtypes if n != coef)
    return blocks.select(*kept, coef).mapInArrow(run, f"{schema}, `{out}` array<double>")


def level_shift(px: Column) -> Column:
    """Samples around 128 (M5)."""
    return F.transform(px, lambda v: v + 128)
