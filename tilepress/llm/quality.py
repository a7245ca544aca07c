"""Quality: a sparse ensemble of rules.

Statistics of every text are computed once. Shallow boosted trees over them give paths; each path is a conjunctive rule. A
lasso logistic fit weighs the rules; what is left compiles to one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import table, text_batches, text_of, written
from tilepress.llm._fit import FIT_ROWS, fold, sample
from tilepress.llm._text import Words, slices, texts

STATS = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digit", "symbol", "stop", "bang", "pipe", "mark", "space",
    "distinct", "top_word", "lines_per_word", "repeated_lines", "wide", "symbol_words",
)
TREES, DEPTH, BINS = 40, 3, 48
THRESHOLD = 0.3


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = {
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _class("0123456789"),
    "symbol": _class("#$%&*+<=>@^_~{}[]\\/`"),
    "stop": _class("."),
    "bang": _class("!?"),
    "pipe": _class("|"),
    "mark": _class(",;:'\"()-"),
    "space": _class(" \t\n\v\f\r"),
}


def statistics(items: list[bytes]) -> np.ndarray:
    """A row of STATS for each text; the empty text has zeros."""
    out = []
    for a, b in slices(items):
        part = items[a:b]
        w = Words(part, lower=False)
        size = np.fromiter((len(x) + 1 for x in part), np.int64, b - a)
        first = np.cumsum(size) - size
        doc, n = w.doc, np.maximum(w.per_doc, 1)
        sums = {k: np.add.reduceat(v[w.data], first, dtype=np.int64) for k, v in _CLASSES.items()}
        sums["space"] = sums["space"] - 1  # the joint after each text
        wide = np.add.reduceat(w.data >= 128, first, dtype=np.int64)
        length = w.ends - w.starts
        order = np.lexsort((w.hash, doc))
        same_doc, same_word = np.diff(doc[order]) == 0, np.diff(w.hash[order].view(np.int64)) == 0
        head = np.concatenate(([True], ~(same_doc & same_word))) if len(order) else np.zeros(0, bool)
        runs = np.diff(np.append(np.flatnonzero(head), len(order)))
        owner = doc[order][head]
        distinct = np.bincount(owner, minlength=b - a)
        top = np.zeros(b - a)
        np.maximum.at(top, owner, runs)
        longest = np.zeros(b - a)
        np.maximum.at(longest, doc, length)
        bytes_in_words = np.bincount(doc, length, b - a)
        marked = np.concatenate(([0], np.cumsum(_CLASSES["symbol"][w.data])))
        symbol_words = np.bincount(doc, (marked[w.ends] - marked[w.starts]) > 0, b - a)
        lines = np.array([x.count(b"\n") + 1 for x in part])
        repeated = np.array([1 - len(set(y)) / len(y) if len(y := [z for z in x.split(b"\n") if len(z) > 2]) > 1 else 0.0 for x in part])
        full = np.maximum(size - 1, 1)
        rows = [
            np.log1p(size - 1), np.log1p(w.per_doc), bytes_in_words / n, np.log1p(longest), sums["upper"] / full, sums["digit"] / full, sums["symbol"] / full, sums["stop"] / n, sums["bang"] / n, sums["pipe"] / n, sums["mark"] / n, sums["space"] / full,
            distinct / n, top / n, lines * (size > 1) / n, repeated, wide / full, symbol_words / n,
        ]
        out.append(np.stack([np.asarray(r, float) for r in rows], 1))
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a column for each of STATS; one row per document row. Null ids stay null, repeated rows give repeated rows, an
    empty table gives none; statistics of null and empty texts are zeros. Other columns are ignored, whatever their names."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = statistics(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, k]) for k in range(len(STATS))]], names=["doc_id", *STATS])

    schema = "doc_id long, " + ", ".join(f"{k} double" for k in STATS)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


#: A rule is a conjunction of (statistic number, is at most, bound).
Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """Paths to all nodes of gradient-boosted trees on random subsets of rows and statistics, grown on quantile bins."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    z = np.full(n, np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    rules: dict[Rule, None] = {}

    def grow(rows: np.ndarray, path: Rule, g: np.ndarray, h: np.ndarray, level: int, some: np.ndarray) -> None:
        if path:
            rules.setdefault(tuple(sorted(path)))
        best = (1e-3, -1, -1)
        if level < depth and len(rows) >= 20:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j in some:
                k = len(edges[j])
                if not k:
                    continue
                cg, ch = (np.cumsum(np.bincount(codes[rows, j], v[rows], k + 1))[:-1] for v in (g, h))
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], j, at)
        if best[1] < 0:
            z[rows] -= 0.3 * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, j, at = best
        low = codes[rows, j] <= at
        for side, own in ((True, rows[low]), (False, rows[~low])):
            grow(own, (*path, (int(j), side, float(edges[j][at]))), g, h, level + 1, some)

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(n) < 0.7)
        if len(rows):
            grow(rows, (), p - y, p * (1 - p), 0, rng.choice(m, max(3, m // 2), replace=False))
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, bound in rule:
        out &= (x[:, j] <= bound) == low
    return out


def lasso(features: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of an L1 logistic regression by accelerated proximal gradient steps."""
    n, m = features.shape
    w, b = np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if not n or not m:
        return w, b
    v = np.ones(m)
    for _ in range(20):
        v = features.T @ (features @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * (np.linalg.norm(features @ v) ** 2 / n + 1) * 1.05)
    at, at_b, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ at + at_b, -40, 40)))
        new = at - rate * (features.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = at_b - rate * (p - y).mean()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, at_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The same as a Spark column over the statistics."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for j, low, bound in rule:
                c = F.col(STATS[j])
                test = test & (c <= F.lit(bound) if low else c > F.lit(bound))
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, penalty: float = 5e-4) -> RuleEnsemble:
    """Learns from the statistics and labels of at most `rows` labelled ids. Of rows that repeat a labelled id the one with the least
    statistics counts; of repeated labels the larger; rows without id or label are passed over."""
    chosen = F.broadcast(sample(labels, label, rows=rows))  # at most `rows` ids
    own = stats.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*STATS)).alias("stats"))
    found = sorted(own.select("label", "stats.*").collect(), key=lambda r: (r[1:], r[0]))  # at most `rows` rows
    y = np.array([r[0] > 0 for r in found], float)
    x = np.array([r[1:] for r in found], float).reshape(len(found), len(STATS))
    rules = tree_rules(x, y)
    features = np.stack([holds(r, x) for r in rules], 1).astype(float) if rules else np.zeros((len(x), 0))
    w, bias = lasso(features, y, penalty)
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(tuple(rules[k] for k in some), tuple(float(w[k]) for k in some), float(bias))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of null and empty texts are zeros; they get the score that the rules give to zeros."""
    stats = written(text_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    model = fit(stats, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = stats.select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
