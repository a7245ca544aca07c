"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit takes at most: those with the smallest hash of their id.
FIT_ROWS = 20_000


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def sample(labels: DataFrame, label: str, id_col: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label) of at most `rows` labelled rows with an id; of repeated ids the larger label counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
