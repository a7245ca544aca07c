"""Inputs made up on the executors from spark.range; the same call gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_vector(spark: SparkSession, n: int, low: float = -10.0, high: float = 10.0, seed: int = 12345) -> DataFrame:
    """(idx, v) uniform in low..high, by a hash of the index, so partitions do not matter."""
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    return spark.range(n).select(F.col("id").alias("idx"), (unit * (high - low) + low).cast("float").alias("v"))


def _rows(spark: SparkSession, rows: int, columns: int, cell) -> DataFrame:
    grid = F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))
    r = F.col("id")
    return spark.range(rows).select(r.cast("int").alias("row"), F.transform(grid, lambda c: cell(r * columns + c, r, c).cast("float")).alias("vec"))


def wave_matrix(spark: SparkSession, rows: int, columns: int, a: float = 0.11, b: float = 0.07, c: float = 0.0) -> DataFrame:
    """sin(a * idx) + cos(b * (row + col)), with c also + c * sin(0.17 * (row * col + 1))."""
    return _rows(spark, rows, columns, lambda i, r, k: F.sin(a * i) + F.cos(b * (r + k)) + (c * F.sin(0.17 * (r * k + 1)) if c else F.lit(0.0)))


def ramp_matrix(spark: SparkSession, rows: int = 8, columns: int = 8) -> DataFrame:
    """0.25 * col + 0.5 * row."""
    return _rows(spark, rows, columns, lambda i, r, k: k * 0.25 + r * 0.5)


def low_rank_matrix(spark: SparkSession, rows: int, columns: int, rank: int = 32, seed: int = 7) -> DataFrame:
    """L R with standard normal factors; the right one travels with the task, the left one is made per row from the seed."""
    right = np.random.default_rng(seed).standard_normal((rank, columns))

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_pylist()
            if ids:
                left = np.stack([np.random.default_rng([seed, i]).standard_normal(rank) for i in ids])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(list((left @ right).astype(np.float32)), pa.list_(pa.float32()))], names=["row", "vec"])

    return spark.range(rows).mapInArrow(make, "row int, vec array<float>")


def _step(x: np.ndarray) -> np.ndarray:
    """One step of a 32-bit xorshift generator (shifts 13, 17, 5)."""
    x = x ^ x << np.uint32(13)
    x = x ^ x >> np.uint32(17)
    return x ^ x << np.uint32(5)


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products over GF(2): the columns of the matrix whose bits are set in x, combined by exclusive or."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def xorshift_matrix(spark: SparkSession, rows: int, columns: int, seed: int = 0x13579BDF) -> DataFrame:
    """(row, vec) of float32 in [-1, 1) from a 32-bit xorshift generator, row after row.

    A step is linear over GF(2), so its powers by squaring lead straight to the state at which a row starts: rows are made
    on their own, on any task, and are the values of the one sequence.
    """
    power, jump = _step(np.uint32(1) << np.arange(32, dtype=np.uint32)), np.uint32(1) << np.arange(32, dtype=np.uint32)
    left = columns
    while left:  # `columns` steps at once
        if left & 1:
            jump = _apply(power, jump)
        power, left = _apply(power, power), left >> 1
    jumps = [jump]
    while len(jumps) < max(1, rows.bit_length()):
        jumps.append(_apply(jumps[-1], jumps[-1]))

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lanes = max(1, (1 << 20) // max(1, columns))
            for first in range(0, len(ids), lanes):
                own = ids[first : first + lanes]
                x, out = np.full(len(own), seed, np.uint32), np.empty((len(own), columns), np.float32)
                for bit, m in enumerate(jumps):
                    x = np.where(own >> bit & 1, _apply(m, x), x)
                for k in range(columns):
                    x = _step(x)
                    out[:, k] = (x & np.uint32(0xFFFFFF)).astype(np.float32) / np.float32(0x1000000) * np.float32(2) - np.float32(1)
                offsets = pa.array(np.arange(0, out.size + 1, columns, dtype=np.int32) if columns else np.zeros(len(own) + 1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["row", "vec"])

    return spark.range(rows).mapInArrow(make, "row int, vec array<float>")


def xorshift_values(n: int, seed: int = 0x13579BDF) -> np.ndarray:
    """The first n values of that generator one after the other, for small n on the driver; xorshift_matrix is the distributed form."""
    out, x = np.empty(n, np.float32), seed
    for i in range(n):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        out[i] = np.float32(x & 0xFFFFFF) / np.float32(0x1000000) * np.float32(2) - np.float32(1)
    return out
