"""Per-row selection of the largest magnitudes, its removal, and its addition back.

Wide rows are handled inside the row, without a shuffle; long form uses a window that Spark limits before the exchange.
NaN ranks below everything; ties go to the lower column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilepress.functions import floats as fl


def importance(v: Column) -> Column:
    return F.when(F.isnan(v), F.lit(float("-inf"))).otherwise(F.abs(v).cast("double"))


def picks(vec: str | Column, k: int) -> Column:
    """array<struct<col, v>> of the k elements of largest magnitude, in rank order."""
    keyed = F.transform(vec, lambda v, i: F.struct((-importance(v)).alias("key"), i.alias("col"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: F.struct(x["col"].alias("col"), x["v"].alias("v"))) if k > 0 else F.slice(F.transform(keyed, lambda x: F.struct(x["col"].alias("col"), x["v"].alias("v"))), 1, 0)


def extract(wide: DataFrame, k: int) -> DataFrame:
    """(row, picks)."""
    return wide.select("row", picks("vec", k).alias("picks"))


def separate(wide: DataFrame, k: int) -> DataFrame:
    """(row, picks, vec): the picked cells are set to zero in vec."""
    found = wide.withColumn("picks", picks("vec", k))
    zeroed = fl.let(F.transform("picks", lambda p: p["col"]), lambda places: F.transform("vec", lambda v, i: F.when(F.array_contains(places, i), fl.f32(0)).otherwise(v)))
    return found.select("row", "picks", zeroed.alias("vec"))


def extract_long(long: DataFrame, k: int) -> DataFrame:
    """(row, rank, col, v) of a long matrix; rank from 0."""
    w = Window.partitionBy("row").orderBy(importance(F.col("v")).desc(), "col")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("row", (F.col("rank") - 1).alias("rank"), "col", "v")


def separate_long(long: DataFrame, k: int) -> DataFrame:
    """The long matrix with the picked cells set to zero; one window, no join."""
    w = Window.partitionBy("row").orderBy(importance(F.col("v")).desc(), "col")
    return long.withColumn("rank", F.row_number().over(w)).select("row", "col", F.when(F.col("rank") <= k, F.lit(0.0).cast("float")).otherwise(F.col("v")).alias("v"))


def decompress(sparse: DataFrame, columns: int) -> DataFrame:
    """(row, vec) with the picks set and zero elsewhere; sparse is (row, picks)."""
    grid = F.sequence(F.lit(0), F.lit(columns - 1))
    vec = fl.let(F.map_from_entries("picks"), lambda held: F.transform(grid, lambda i: F.coalesce(F.element_at(held, i), fl.f32(0))))
    return sparse.select("row", vec.alias("vec"))


def add(vec: str | Column, sparse: str | Column) -> Column:
    """vec plus the picks of a sparse array, in float32; a missing sparse array adds nothing."""
    held = F.map_from_entries(F.coalesce(sparse, F.array().cast("array<struct<col:int,v:float>>")))
    return fl.let(held, lambda m: F.transform(vec, lambda v, i: F.when(F.map_contains_key(m, i), v + F.element_at(m, i)).otherwise(v)))


def apply(wide: DataFrame, sparse: DataFrame) -> DataFrame:
    """Adds (row, picks) to (row, vec)."""
    return wide.join(sparse, "row", "left").select("row", add("vec", F.col("picks")).alias("vec"))
