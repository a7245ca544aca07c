"""Connected components of an edge table by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilepress.llm._common import drop, scratch


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of v for u. An aggregate and a join, so that the rows of a hot u can be split."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (u, v) long. Returns (node, root) for every node of an edge that is not its component's least node itself.

    Large star: every neighbour above u is tied to the least of u and its neighbours, and so is u itself if it is not that.
    Small star: u and its smaller neighbours are tied to the least of them. Each edge makes one row in the first step and two
    in the second; both are one aggregate and one join. Settled when a round changes nothing. A self-loop alone gives no row.
    """
    spark, mark, last = edges.sparkSession, None, None
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    for _ in range(rounds + 1):
        path = scratch(spark, "cc")
        e.write.parquet(path)
        e = spark.read.schema("u long, v long").parquet(path)
        if last:
            drop(spark, last)
        last = path
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*")
        up = F.col("v") > F.col("u")
        large = _least(both).select(F.when(up, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(up, F.least("u", "m")).otherwise(F.col("m")).alias("v")).distinct()
        small = _least(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = small.where("u != v").distinct()
    raise RuntimeError(f"components did not settle in {rounds} rounds")
