"""Exact deduplication by a stateful stream.

The texts' digests flow through a Structured Streaming aggregation whose keyed state lives in RocksDB on the executors'
disks and never expires: per digest it retains the stable identifier and the content locator of the row that stays, and
the number of rows. Every digest hit is then checked on the full bytes, which are fetched by locator; digests under which
different texts meet are grouped again by the text itself. Only DataFrame functions and native stateful operators run.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import SPACE, scratch, table, text_of, written


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is the empty text."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def row_locator() -> Column:
    """Where a row of files stands: file and place in it."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def stream_ledger(spark: SparkSession, staged: str, schema, state_dir: str, max_bytes: int = 64 << 30) -> DataFrame:
    """Runs what is new in the folder `staged` (digest, row, locator) through the keyed state kept under state_dir.

    One row per digest: keep (the smallest row: doc_id, nulls last, then row number), locator of that row, group_size.
    Calling it again after more files have come continues from the state: the streaming checkpoint knows what was read.
    """
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition preallocates files
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        session.conf.set(key, value)
    rows = session.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(staged)
    state = rows.groupBy("digest").agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("group_size"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_dir}/ledger/batch={number}")  # a repeated batch replaces itself

    query = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", f"{state_dir}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )
    query.awaitTermination()
    ledger = spark.read.schema("digest string, keep struct<no_id: boolean, doc_id: bigint, number: bigint, locator: string>, group_size bigint, batch int").parquet(f"{state_dir}/ledger")
    # updates only lower `keep` and raise the size, so the last state of a digest is their minimum and maximum
    return ledger.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, state_dir: str | None = None, max_bytes: int = 64 << 30) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when identical after white-space normalisation; of equal texts the row with the smallest id stays
    (null ids come last; of repeated rows with one id a single one stays). Null and empty texts are the empty text and equal
    each other. An empty table gives no rows. Columns besides id and text are ignored, whatever their names.
    digest: text column -> string column, by default sha256. It may collide: hits are decided on the bytes.
    state_dir: folder of the state; give the same one with new rows to deduplicate against all earlier rows too. The folder then
    keeps the texts as well, so that a hit on an earlier row is compared on full bytes.
    """
    spark = docs.sparkSession
    digest = digest or sha256
    try:
        docs.select("_metadata.row_index")
        keep_texts = state_dir is not None
    except AnalysisException:  # not read from files: written once, so that every row has a place of its own
        keep_texts = True
    state_dir, held = state_dir or scratch(spark, "dedup-state"), docs
    if keep_texts:
        home, schema = f"{state_dir}/texts", "doc_id bigint, text string"
        new = f"{home}/{uuid.uuid4().hex}"
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).write.parquet(new)
        docs, held = spark.read.schema(schema).parquet(new), spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(home)
        id_col, text_col = "doc_id", "text"
    base, held = (x.select(F.col(id_col).cast("bigint").alias("doc_id"), row_locator().alias("locator"), normalised(F.col(text_col)).alias("norm")) for x in (docs, held))
    staged_rows = base.select(
        digest(F.col("norm")).alias("digest"),
        sha256(F.col("norm")).alias("text_sha256"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("number"), "locator").alias("row"),
    )
    staged_rows.write.mode("append").parquet(f"{state_dir}/rows")
    schema = staged_rows.schema
    staged = spark.read.schema(schema).parquet(f"{state_dir}/rows")
    ledger = written(stream_ledger(spark, f"{state_dir}/rows", schema, state_dir, max_bytes), "dedup-ledger")

    # full bytes of every hit, fetched by locator; one digest's least and greatest text agree if and only if all do
    hits = staged.join(ledger.where("group_size > 1").select("digest"), "digest").select("digest", F.col("row.locator").alias("locator"))
    fetched = held.select("locator", "norm").join(hits, "locator")
    checked = fetched.groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("differs"))
    checked = written(checked.where("differs"), "dedup-checked")
    clash = bool(checked.take(1))

    rows = staged.select("digest", "text_sha256", "row")
    plain = rows.join(ledger, "digest")
    if clash:
        plain = plain.join(checked, "digest", "left_anti")
    fields = [
        F.col("row.doc_id").alias("doc_id"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row") == F.col("keep")).alias("kept"),
        F.col("text_sha256"),
        F.col("row.locator").alias("locator"),
    ]
    out = plain.select(*fields)
    if clash:  # different texts under one digest: group them by their bytes
        clashing = rows.join(checked.select("digest"), "digest")
        texts = held.select("locator", "norm", sha256(F.col("norm")).alias("text_sha256"))
        clashing = clashing.withColumn("locator", F.col("row.locator")).join(texts, ["locator", "text_sha256"]).dropDuplicates(["row"])
        groups = clashing.groupBy(F.col("norm").alias("text")).agg(F.min("row").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(clashing.join(groups, F.col("norm") == F.col("text")).select(*fields))
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: The same rows in DuckDB.
OP10_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
