"""Substring deduplication by content-defined chunks.

A gear rolling hash cuts every text where the last bytes say so, so an insertion shifts cuts only near itself. Chunks are named
by the digest of their bytes; the first occurrence in (id, position) order stays, every later one is removed from its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import table, text_batches, text_of, written
from tilepress.llm._text import texts
from tilepress.llm.bpe import gear_cuts

#: Expected and least bytes of a chunk. A repeated passage loses what lies between the first and last cut inside it.
MEAN, LEAST = 32, 16
#: Bytes of the shortest run of repeated chunks that is removed. Phrases that come again by chance or habit are shorter (a license
#: line, a common turn); of a passage of just over 50 words more than that lies between two cuts in some 97 of 100 cases.
RUN = 2 * MEAN
#: A digest with more than this share of all chunks is hot. There are fewer hot digests than its inverse, so they can be broadcast;
#: their rows are dealt to SALTS groups when they are joined to their first place.
HOT_SHARE, SALTS = 1 / 4096, 64


def chunk_ends(data: bytes, mean: int = MEAN, least: int = LEAST) -> list[int]:
    """Ends of the chunks in bytes, on code-point borders; cuts nearer than `least` to the last one are passed over."""
    ends, last = [], 0
    for cut in gear_cuts(data, mean).tolist() if data else []:
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
        if cut - last >= least and cut < len(data):
            ends.append(cut)
            last = cut
    if len(data) > last:
        ends.append(len(data))
    return ends


def _digests(pieces: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two 64-bit integers."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in pieces]), np.int64).reshape(-1, 2)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN, least: int = LEAST, run: int = RUN, outputs: bool = False, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per document row: doc_id, n_chunks, n_repeated (chunks that are removed), removed_bytes, and spans: "start:end" in
    bytes of the removed runs, comma-joined; with outputs also the text that is left.

    Of equal chunks (by 128-bit digest and length) the one with the smallest (row with the smallest id, position) stays; null ids
    come last, repeated rows in input order. Later ones are removed where they make up a run of at least `run` bytes; shorter runs
    stay and are not counted. Null and empty texts have no chunks. An empty table gives no rows. Other columns are ignored,
    whatever their names. hot_share: digests with more than this share of all chunks are salted.
    """
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    if outputs:  # read twice, and both readings must see the same keys
        base = written(base, "substring-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, ends = [], [], []
            for data in texts(batch.column(2)):
                e = chunk_ends(data, mean, least)
                d = _digests([data[a:b] for a, b in zip([0, *e], e)])  # noqa: B905
                high.append(d[:, 0])
                low.append(d[:, 1])
                ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int32()))], names=["key", "doc_id", "high", "low", "ends"])

    chunked = written(base.mapInArrow(cut, "key long, doc_id long, high array<long>, low array<long>, ends array<int>"), "substring-chunks")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    flat = chunked.select(rank.alias("rank"), "ends", F.posexplode(F.arrays_zip("high", "low")).alias("pos", "digest"))
    length = F.element_at("ends", F.col("pos") + 1) - F.when(F.col("pos") > 0, F.element_at("ends", F.greatest("pos", F.lit(1)))).otherwise(0)
    flat = flat.select("digest.high", "digest.low", length.alias("length"), F.struct("rank", "pos").alias("place"))
    # only digests that occur twice or more travel on: sums per digest are combined before the shuffle
    digest = ["high", "low", "length"]
    first = flat.groupBy(*digest).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1")
    first = written(first, "substring-first")
    total = chunked.agg(F.coalesce(F.sum(F.size("ends")), F.lit(0))).first()[0]
    hot = F.broadcast(first.where(F.col("n") > F.lit(hot_share * total)).select(*digest, F.lit(True).alias("hot")))  # fewer than 1 / hot_share rows
    salted = flat.join(hot, digest, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("place.rank.key"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    salts = F.when(F.col("n") > F.lit(hot_share * total), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    again = salted.join(first.select(*digest, "first", F.explode(salts).alias("salt")), [*digest, "salt"]).where(F.col("place") > F.col("first"))
    removed = again.groupBy(F.col("place.rank.key").alias("key")).agg(F.array_sort(F.collect_list("place.pos")).alias("removed"))  # at most a text's chunks
    joined = chunked.select("key", "doc_id", "ends").join(removed, "key", "left").select("key", "doc_id", "ends", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_chunks, n_repeated, size, spans = [], [], [], []
            for e, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs: list[list[int]] = []  # start, end, chunks
                for k in gone:
                    a, b = (e[k - 1] if k else 0), e[k]
                    if runs and runs[-1][1] == a:
                        runs[-1][1:] = b, runs[-1][2] + 1
                    else:
                        runs.append([a, b, 1])
                runs = [r for r in runs if r[1] - r[0] >= run]
                n_chunks.append(len(e))
                n_repeated.append(sum(r[2] for r in runs))
                size.append(sum(b - a for a, b, _ in runs))
                spans.append(",".join(f"{a}:{b}" for a, b, _ in runs))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n_chunks, pa.int64()), pa.array(n_repeated, pa.int64()), pa.array(size, pa.int64()), pa.array(spans, pa.string())], names=["key", "doc_id", "n_chunks", "n_repeated", "removed_bytes", "spans"])

    found = joined.mapInArrow(spans, "key long, doc_id long, n_chunks long, n_repeated long, removed_bytes long, spans string")
    if not outputs:
        return found.drop("key")
    whole = found.join(base.select("key", "text"), "key").drop("key")

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_without(x, s) for x, s in zip(texts(batch.column(5)), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(left, pa.binary()).cast(pa.string())], names=batch.schema.names)

    return whole.mapInArrow(without, "doc_id long, n_chunks long, n_repeated long, removed_bytes long, spans string, text string")


def _without(data: bytes, spans: str) -> bytes:
    out, last = [], 0
    for run in spans.split(",") if spans else []:
        a, b = map(int, run.split(":"))
        out.append(data[last:a])
        last = b
    return b"".join([*out, data[last:]])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
