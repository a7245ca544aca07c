"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import forget, table, text_batches, text_of, written
from tilepress.llm._fit import FIT_ROWS, fold, sample
from tilepress.llm._text import slices

#: Lengths of the character n-grams, and bits of their hashed space.
LENGTHS, BITS = (3, 4, 5), 20
#: Size of the model: n-grams that enter the linear fit, those whose presence tells the classes apart most (G statistic). A
#: parameter of the fit; no row or text is passed over for it.
FEATURES = 4096
#: Tasks over the bounded sample.
FIT_TASKS = 8
THRESHOLD = 0.3
_FACTORS = np.random.default_rng(977).integers(0, 2**31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PAD = "\0" * (max(LENGTHS) - 1)


def present(items: list[str], keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: number of texts, then (text number, feature) of distinct lower-cased n-grams, sorted.

    A text's last n-grams run into padding, so its end counts; nothing of a neighbouring text does. keep: bool per feature.
    """
    for a, b in slices([x.encode("utf-8", "surrogatepass") for x in items], 1 << 19):
        part = [x.lower() + _PAD for x in items[a:b]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, part), np.int64, b - a)
        doc = np.repeat(np.arange(b - a), size)
        start = np.ones(len(codes), bool)
        ends = np.cumsum(size)
        for k in range(1, len(_PAD) + 1):
            start[ends - k] = False
        found = []
        h = np.zeros(len(codes), np.uint32)
        for k in range(max(LENGTHS)):
            h = h[: len(codes) - k] + codes[k:] * _FACTORS[k]
            if k + 1 in LENGTHS:
                g = h ^ np.uint32((k + 1) * 0x5BD1E995 & 0xFFFFFFFF)
                g = (g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                g = (g ^ (g >> np.uint32(12))) * np.uint32(0x297A2D39)
                g >>= np.uint32(32 - BITS)
                ok = start[: len(g)] if keep is None else keep[g] & start[: len(g)]
                at = np.flatnonzero(ok)
                found.append(doc[at] << BITS | g[at])
        pairs = np.unique(np.concatenate(found))
        yield b - a, pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # hashed n-grams
    weights: np.ndarray  # of their presence: linear weight times log-count ratio
    bias: float

    def score(self, items: list[str]) -> np.ndarray:
        keep, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        keep[self.features], weight[self.features] = True, self.weights
        out = []
        for n, doc, feature in present(items, keep):
            out.append(np.bincount(doc, weight[feature], n) + self.bias)
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(indices: np.ndarray, rows: np.ndarray, value: np.ndarray, y: np.ndarray, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on binary features times value, by accelerated gradient steps."""
    n, m = len(y), len(value)
    w, b = np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if n == 0 or len(indices) == 0:
        return w, b
    share = np.bincount(indices, minlength=m) / n * value**2
    rate = 1 / (0.25 * share + ridge + 1e-3)  # a diagonal scaling, damped by the number of features a row has
    rate /= max(1.0, np.percentile(np.bincount(rows, minlength=n), 90) ** 0.5)
    v, vb, last_w, last_b = w.copy(), b, w, b
    for k in range(1, steps + 1):
        z = np.bincount(rows, (value * v)[indices], n) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = value * np.bincount(indices, (p - y)[rows], m) / n + ridge * v
        w, b = v - rate * g, vb - (p - y).mean() * 2
        move = (k - 1) / (k + 2)
        if g @ (w - last_w) > 0:  # restart when the momentum climbs
            move = 0
        v, vb, last_w, last_b = w + move * (w - last_w), b + move * (b - last_b), w, b
    return w, b


def ngram_counts(rows: DataFrame) -> DataFrame:
    """(feature, neg, pos): texts of either class that hold an n-gram, from (text, label). Counts are added up in each task, then by
    feature; what leaves a task is bounded by the hashed space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            y = np.array(batch.column(1).to_pylist()) > 0
            at = 0
            for size, doc, feature in present(batch.column(0).to_pylist()):
                own = y[at : at + size]
                for c in (0, 1):
                    seen[c] += np.bincount(feature[own[doc] == c], minlength=1 << BITS).astype(np.int32)
                at += size
        some = np.flatnonzero(seen.any(0))
        for part in np.array_split(some, -(-len(some) // 65_536)) if len(some) else ():
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[0, part]), pa.array(seen[1, part])], names=["feature", "neg", "pos"])

    found = rows.select("text", "label").mapInArrow(count, "feature int, neg int, pos int")
    return found.groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def chosen_features(counts: DataFrame, neg: int, pos: int, features: int = FEATURES) -> DataFrame:
    """(feature, ratio) of the n-grams that tell the classes apart most, at most `features`, by the G statistic of their presence.

    ratio: log of the smoothed shares of texts with the n-gram, positive class over negative."""
    n = neg + pos
    p_neg, p_pos = (F.col("neg") + 0.5) / F.lit(neg + 1.0), (F.col("pos") + 0.5) / F.lit(pos + 1.0)
    pooled = (F.col("neg") + F.col("pos") + 1) / F.lit(n + 2.0)

    def part(k: str, p, m: int):
        return F.col(k) * F.log(p / pooled) + (F.lit(m) - F.col(k)) * F.log(F.greatest(1 - p, F.lit(1e-12)) / F.greatest(1 - pooled, F.lit(1e-12)))

    some = counts.where(F.col("neg") + F.col("pos") >= 4).select("feature", F.log(p_pos / p_neg).alias("ratio"), (part("neg", p_neg, neg) + part("pos", p_pos, pos)).alias("g"))
    return some.where("g > 4").orderBy(F.desc("g"), "feature").limit(features).select("feature", "ratio")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, ridge: float = 1e-4, features: int = FEATURES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most `rows` labelled rows; only their texts and labels are looked at. Of rows that repeat a labelled id the
    least text counts; rows without id or label are passed over. rows and features bound what the driver fits."""
    text_batches(docs.sparkSession)
    chosen = F.broadcast(sample(labels, label, id_col, rows=rows))  # at most `rows` ids
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).join(chosen, "doc_id")
    found = written(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxicity-sample").repartition(FIT_TASKS)
    n = {r.label > 0: r["count"] for r in found.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    picked = sorted((r.feature, r.ratio) for r in chosen_features(ngram_counts(found), n.get(False, 0), n.get(True, 0), features).collect())
    known, ratio = np.array([f for f, _ in picked], np.int64), np.array([r for _, r in picked])
    keep = np.zeros(1 << BITS, bool)
    keep[known] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for size, doc, feature in present(batch.column(0).to_pylist(), keep):
                own = np.split(np.searchsorted(known, feature).astype(np.int32), np.searchsorted(doc, np.arange(1, size)))
                lists += [x.tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.binary())], names=["label", "features"])

    y, lists = [], []
    for r in found.select("text", "label").mapInArrow(pick, "label int, features binary").toLocalIterator():  # at most `rows`
        y.append(r.label > 0)
        lists.append(np.frombuffer(bytes(r.features), np.int32))
    size = [len(x) for x in lists]
    indices = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    w, bias = _logistic(indices, np.repeat(np.arange(len(lists)), size), ratio, np.array(y, float), ridge)
    return Model(known, w * ratio, bias)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and score in 0 to 1. Only the text is read; null is the empty text, which has the score of
    no evidence. Repeated rows give repeated rows, null ids stay null, an empty table gives no rows."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and as often as they come, whose text scores below the threshold. Null is the empty text."""
    text_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            text = ["" if x is None else x for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.score(text) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 4) != 2))
    scored = toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
