"""Error metrics in double precision, one pass with partial aggregation."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measure(pairs: DataFrame, actual: str = "v", decoded: str = "decoded") -> DataFrame:
    """One row: n, mae, mse, max_abs of (actual, decoded)."""
    d = F.col(actual).cast("double") - F.col(decoded).cast("double")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("max_abs"))


def measure_blocks(blocks: DataFrame) -> DataFrame:
    """The same over a block table (vals, decoded)."""
    return measure(blocks.select(F.explode(F.arrays_zip("vals", "decoded")).alias("p")).select("p.vals", "p.decoded"), "vals")


def latency(run: Callable[[], object], warmup: int = 5, runs: int = 30) -> dict[str, float]:
    """Milliseconds of a call: avg, min, p50, p95 and max over `runs` calls after `warmup` ones that do not count."""
    took = []
    for k in range(warmup + runs):
        began = time.perf_counter()
        run()
        if k >= warmup:
            took.append((time.perf_counter() - began) * 1000)
    if not took:
        raise ValueError("runs must be at least 1")
    return {"avg": float(np.mean(took)), "min": min(took), "p50": float(np.percentile(took, 50)), "p95": float(np.percentile(took, 95)), "max": max(took)}
