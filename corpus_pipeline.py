"""The corpus pipeline: five stages, each over all that its predecessor kept, each calling one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import recorded, scratch, written
from tilepress.llm.bpe import bpe_encode, word_tokenizer
from tilepress.llm.exact_dedup import exact_dedup, row_locator
from tilepress.llm.mixing import mix_sources
from tilepress.llm.near_dedup import near_dedup
from tilepress.llm.toxicity import fit, without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Files whose numbers are broadcast; rows of more files are written with keys of their own instead.
MAX_FILES = 100_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key, a number of their own for all rows: ids may be null or repeat.

    In files it is the number of the file and the place of the row in it, so every reading gives the same; other rows are written first.
    """
    spark = docs.sparkSession
    try:
        at = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_at"))
        files = [r.row_file for r in at.select("row_file").distinct().limit(MAX_FILES + 1).collect()]
    except AnalysisException:  # not read from files
        files = None
    if files is None or len(files) > MAX_FILES:
        return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "pipeline-rows")
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(sorted(files))), "number long, row_file string"))  # at most MAX_FILES rows
    return at.join(numbers, "row_file").select(*COLUMNS, (F.shiftleft("number", 40) + F.col("row_at")).alias("row_key"))


def _first_of_each(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Of the rows of each group (row_key, group) the one with the smallest id, null ids last; a single one of rows that repeat it."""
    ids = keyed.select("doc_id", "row_key").join(groups, "row_key")
    stay = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("stays"))
    return keyed.join(stay.select("stays.row_key"), "row_key", "left_semi").select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents. The classifier learns from the labelled rows; texts without evidence stay."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without_toxic(docs.select(*COLUMNS), model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays, null ids last; a single one of rows that repeat it. The operator
    names each row by its file and place, so ids may be null or repeat."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not read from files
        docs = written(docs.select(*COLUMNS), "pipeline-rows")
    stay = exact_dedup(docs).where("kept").select("locator")
    return docs.select(*COLUMNS, row_locator().alias("locator")).join(stay, "locator", "left_semi").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more) the document with the smallest id stays."""
    keyed = _keyed(docs)
    found = near_dedup(keyed, id_col="row_key", percent=80, least=12)
    return _first_of_each(keyed, found.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("group")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents it takes, each as often as it takes them."""
    keyed = _keyed(docs)
    taken = mix_sources(keyed, row_col="row_key").where("copies > 0").select("row_key", "copies")
    return keyed.join(taken, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document of the mix."""
    return bpe_encode(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Training, signatures and tokenization are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        with recorded(spark):  # the stage's own tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
