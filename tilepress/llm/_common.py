"""What the operators of this subpackage share: the shared scratch folder, written cut points, UDF batches."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that one Arrow batch of texts holds; keeps a worker's memory in tens of MB for usual texts.
TEXT_BATCH = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a session that runs in the
    driver's own process gets a temporary folder; on a cluster that would not be shared, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tilepress-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        pass


#: Lists of the paths that are made while they stand here; see `recorded`.
_records: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    for record in _records:
        record.append(path)
    return path


@contextmanager
def recorded(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables made inside: for results that are written by then."""
    record: list[str] = []
    _records.append(record)
    try:
        yield
    finally:
        _records.remove(record)
        for path in record:
            drop(spark, path)


def written(frame: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the frame as a Parquet table in the shared folder, so that a lost executor costs no recomputation."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def forget() -> None:
    """In a Python worker: gives up what an earlier operator keeps there between its tasks."""
    sys.modules.pop("_tilepress_worker", None)


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the user has chosen a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXT_BATCH))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text: str | Column = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
