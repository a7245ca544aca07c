"""The two physical forms of matrices and vectors, and the blocks of the flattened row-major order.

long: (row, col, v) or (idx, v); wide: (row, vec). Blocks run over the flat index and may straddle rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(wide: DataFrame) -> DataFrame:
    return wide.select("row", F.posexplode("vec").alias("col", "v"))


def to_wide(long: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("col", "v")))
    return long.groupBy("row").agg(F.transform(ordered, lambda x: x["v"]).alias("vec"))


def flat(long: DataFrame, columns: int) -> DataFrame:
    return long.select((F.col("row").cast("long") * columns + F.col("col")).alias("idx"), "v")


def vector_blocks(vector: DataFrame, size: int) -> DataFrame:
    """(block_id, vals) of a flat vector (idx, v) with contiguous idx from 0: one shuffle, whole blocks in each row."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "v")))
    block = F.floor(F.col("idx") / size).cast("long").alias("block_id")
    return vector.select(block, "idx", F.col("v").cast("float").alias("v")).groupBy("block_id").agg(F.transform(ordered, lambda x: x["v"]).alias("vals"))


def matrix_blocks(wide: DataFrame, columns: int, size: int) -> DataFrame:
    """(block_id, vals) of a wide matrix with contiguous rows from 0; no shuffle where rows hold whole blocks."""
    if columns % size:
        return vector_blocks(flat(to_long(wide), columns), size)
    per = columns // size
    parts = F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda j: F.slice("vec", j * size + 1, size))
    return wide.select("row", F.posexplode(parts).alias("part", "vals")).select((F.col("row").cast("long") * per + F.col("part")).alias("block_id"), F.col("vals").cast("array<float>").alias("vals"))


def flatten(blocks: DataFrame, size: int, column: str, name: str, *more: str) -> DataFrame:
    """(idx, name, more...) of an array column of a block table."""
    return blocks.select(*more, "block_id", F.posexplode(column).alias("pos", name)).select((F.col("block_id") * size + F.col("pos")).alias("idx"), name, *more)
