"""Matrices and vectors from tables: projections that keep column pruning at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix(spark: SparkSession, path: str, row: str, vec: str) -> DataFrame:
    """(row, vec) of a Parquet table with one array per row."""
    return spark.read.parquet(path).select(F.col(row).cast("int").alias("row"), F.col(vec).cast("array<float>").alias("vec"))


def vector(spark: SparkSession, path: str, idx: str, value: str) -> DataFrame:
    """(idx, v) of a Parquet table whose index is contiguous from 0."""
    return spark.read.parquet(path).select(F.col(idx).cast("long").alias("idx"), F.col(value).cast("float").alias("v"))


def write_blocks(coded: DataFrame, path: str, parts: int | None = None) -> None:
    """A coded block table as Parquet, by ranges of the block number so that reads of a range prune files."""
    out = coded.repartitionByRange(parts, "block_id") if parts else coded.repartitionByRange("block_id")
    out.sortWithinPartitions("block_id").write.mode("overwrite").parquet(path)
