"""Language-model scores by stupid backoff, computed as joins of count tables partitioned by hash.

N-grams are named by 64-bit hashes; every one is counted, however rare. The texts are packed in runs. Each run's distinct n-grams,
with their counts in it, are dealt to equal ranges of the hash: the partitions of the count table, of one bounded size, so that
their number grows with the corpus. There the counts of equal n-grams are summed, and each run's n-grams are joined to the sums,
which go back in the order in which they came. A run then meets its texts again and scores them. A frequent n-gram is one row per
run, not per occurrence. Rows of one run and one partition travel packed, as sorted differences: the n-grams of a text are nearly
as many as its words, and as rows of their own they would move several times the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepress.llm._common import table, text_batches, text_of, written
from tilepress.llm._text import Words, mix, slices, texts
from tilepress.llm.near_dedup import groups

BACKOFF, MIN_COUNT, ORDER = 0.4, 2, 2
#: Pairs of a word and its bigram for each partition of the count table.
PARTITION_GRAMS = 3_000_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000
#: Bytes of a run of texts; a longer text is a run of its own.
RUN_BYTES = 8 << 20
#: Stand for a word outside a chosen vocabulary, and for the start of a document.
UNKNOWN, START = np.uint64(0), np.uint64(1)


def unigrams(docs: DataFrame) -> DataFrame:
    """(word, n): 64-bit hash of each lower-cased (A-Z) white-space word and its count over all rows of the column `text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_w, held_n, size = [], [], 0

        def merged():
            w, place = np.unique(np.concatenate(held_w), return_inverse=True)
            return w, np.bincount(place, np.concatenate(held_n)).astype(np.int64)

        for batch in batches:
            items = texts(batch.column(0))
            for a, b in slices(items):
                w, n = np.unique(Words(items[a:b]).hash, return_counts=True)
                held_w.append(w)
                held_n.append(n)
                size += len(w)
            if size > 4 * HELD:
                w, n = merged()
                held_w, held_n, size = [w], [n], len(w)
                if size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])
                    held_w, held_n, size = [], [], 0
        if size:
            w, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _press(x) -> bytes:
    return pa.compress(pa.py_buffer(x), codec="zstd", asbytes=True)


def _pressed(x: bytes, size: int) -> bytes:
    return pa.decompress(x, decompressed_size=size, codec="zstd", asbytes=True)


def _items(sizes: list[int], pressed: bytes) -> list[bytes]:
    """The texts of a run."""
    data, ends = _pressed(pressed, sum(sizes)) if sum(sizes) else b"", np.cumsum(sizes).tolist()
    return [data[e - n : e] for n, e in zip(sizes, ends, strict=True)]


def _packed(own: np.ndarray) -> bytes:
    """Sorted hashes as differences, equal bytes of all of them side by side: the high ones press to nothing."""
    steps = np.diff(own, prepend=np.uint64(0))
    return _press(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_pressed(data, 8 * n), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


class Grams:
    """Distinct n-grams of a run of texts, sorted by hash, and where each word of the run finds its own ones.

    at[k] holds for each word the place of the (k + 1)-gram that ends there, history[k] that of the k-gram before it; -1 where the
    text has not so many words before it. A text's first word follows its start. part p of `parts` holds an equal range of hashes.
    """

    def __init__(self, items: list[bytes], parts: int, known: np.ndarray | None = None, order: int = 2):
        doc, found = [], [[] for _ in range(order)]
        for a, b in slices(items):
            w = Words(items[a:b])
            word = w.hash if known is None else np.where(np.isin(w.hash, known), w.hash, UNKNOWN)
            new = np.flatnonzero(np.diff(w.doc, prepend=-1))
            before = np.concatenate((np.array([START]), word[:-1]))[: len(word)]
            before[new] = START
            doc.append(w.doc + a)
            found[0].append(word)
            for k in range(1, order):  # named by the hash of the history and the word
                gram = mix(before + mix(word + np.uint64(0x9E3779B97F4A7C15)))
                found[k].append(gram)
                before = np.concatenate((gram[:1], gram[:-1]))
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        n = len(self.doc)
        place_in_doc = np.arange(n) - np.searchsorted(self.doc, self.doc)
        self.has = [place_in_doc >= k - 1 for k in range(order)]
        grams = [np.concatenate(g) if g else np.zeros(0, np.uint64) for g in found]
        # a start for each text, so that the count of starts is that of the documents
        whole = np.concatenate([*(g[h] for g, h in zip(grams, self.has, strict=True)), np.full(len(items), START)])
        self.own, place, self.n = np.unique(whole, return_inverse=True, return_counts=True)
        start, self.at, first = (place[-1] if len(items) else 0), [], 0
        for h in self.has:
            at = np.full(n, -1)
            at[h] = place[first : first + h.sum()]
            first += int(h.sum())
            self.at.append(at)
        self.history = [np.full(n, -1)]
        for k in range(1, order):
            back = np.concatenate((np.array([-1]), self.at[k - 1][:-1]))[:n]
            back[place_in_doc == 0] = start if k == 1 else -1
            self.history.append(back)
        limits = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
        self.bounds = np.concatenate(([0], np.searchsorted(self.own, limits), [len(self.own)]))


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.0, backoff: float = BACKOFF, min_count: int = MIN_COUNT, order: int = ORDER, partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """One row per document row: doc_id, n_tokens, log_prob (natural log, summed) and score (log_prob per word; 0 without words).

    The model is the table itself, of n-grams up to `order` words (a text's start counts as a word before its first). A word scores
    log(c(history word) / c(history)) for the longest n-gram that occurs min_count times or more, times backoff for each longer one;
    a word alone scores c(word) / N. Null, empty and blank texts have no words. Repeated rows count as often as they occur and
    each get a row; null ids stay null; an empty table gives no rows. Other columns are ignored, whatever their names. share: words
    that make up less of the corpus are one unknown word (there are at most 1 / share others, which are broadcast); 0 keeps all.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    text_batches(spark)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(keys: list, ids: list, part: list[bytes]) -> pa.RecordBatch:
            row = (keys[0], pa.int64()), (len(b" ".join(part).split()), pa.int64()), (ids, pa.list_(pa.int64())), ([len(x) for x in part], pa.list_(pa.int32())), (_press(b"".join(part)), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in row], names=["run", "n", "ids", "sizes", "texts"])

        keys, ids, part, size = [], [], [], 0
        for batch in batches:
            for key, own, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                if size and size + len(x) > RUN_BYTES:
                    yield packed(keys, ids, part)
                    keys, ids, part, size = [], [], [], 0
                keys.append(key)
                ids.append(own)
                part.append(x)
                size += len(x) + 1
        if part:
            yield packed(keys, ids, part)

    # written once: both readers must see the same runs
    runs = written(base.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(pack, "run long, n long, ids array<long>, sizes array<int>, texts binary"), "lm-runs")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(12, -(-total * order // (2 * partition_grams)))
    shared = spark.sparkContext.broadcast(_vocabulary(base, share * total) if share > 0 else None)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, sizes, pressed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                g = Grams(_items(sizes.as_py(), pressed.as_py()), parts, shared.value, order)
                some = np.flatnonzero(np.diff(g.bounds))
                cells = [slice(g.bounds[p], g.bounds[p + 1]) for p in some]
                size = pa.array([c.stop - c.start for c in cells], pa.int32())
                own, n = (pa.array([f(x[c]) for c in cells], pa.binary()) for f, x in ((_packed, g.own), (_press, g.n)))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), run)), size, own, n], names=["p", "run", "size", "grams", "counts"])

    dealt = runs.select("run", "sizes", "texts").mapInArrow(deal, "p int, run long, size int, grams binary, counts binary")
    dealt = dealt.repartition(parts, "p").sortWithinPartitions("p")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 1):
            size = g.column("size").to_numpy()
            own = np.concatenate([_unpacked(x, k) for x, k in zip(g.column("grams").to_pylist(), size.tolist(), strict=True)])
            n = np.concatenate([np.frombuffer(_pressed(x, 8 * k), np.int64) for x, k in zip(g.column("counts").to_pylist(), size.tolist(), strict=True)])
            _, place = np.unique(own, return_inverse=True)
            sums = np.bincount(place, n).astype(np.int64)[place]
            ends = np.cumsum(size)
            back = pa.array([_press(sums[e - k : e]) for k, e in zip(size, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(g.column("run").chunks), pa.concat_arrays(g.column("p").chunks), back], names=["run", "p", "counts"])

    counted = dealt.mapInArrow(count, "run long, p int, counts binary")
    both = counted.unionByName(runs.select("run", F.lit(-1).alias("p"), "ids", "sizes", "texts"), allowMissingColumns=True)
    both = both.repartition(parts, "run").sortWithinPartitions("run", "p")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 1):
            first = {k: t.column(k)[0] for k in ("ids", "sizes", "texts")}  # the texts come first
            ids, items = first["ids"].values, _items(first["sizes"].as_py(), first["texts"].as_py())
            g = Grams(items, parts, shared.value, order)
            n = np.zeros(len(g.own), np.int64)
            for p, x in zip(t.column("p").to_pylist()[1:], t.column("counts").to_pylist()[1:], strict=True):
                n[g.bounds[p] : g.bounds[p + 1]] = np.frombuffer(_pressed(x, 8 * (g.bounds[p + 1] - g.bounds[p])), np.int64)
            if not n.all():
                raise ValueError("counts of a run are missing")
            logs = np.log(n)
            each = logs[g.at[0]] - np.log(max(total, 1))
            for k in range(1, order):
                seen = g.has[k] & (n[g.at[k]] >= min_count)
                each = np.where(seen, logs[g.at[k]] - logs[g.history[k]], each + np.where(g.has[k], np.log(backoff), 0.0))
            sums = np.bincount(g.doc, minlength=len(items)).astype(np.int64), np.bincount(g.doc, each, len(items))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, sums)], names=["doc_id", "n_tokens", "log_prob"])

    sums = both.mapInArrow(scores, "doc_id long, n_tokens long, log_prob double")
    return sums.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).otherwise(0.0).alias("score"))


def _vocabulary(base: DataFrame, least: float) -> np.ndarray:
    """Hashes of the words that occur at least so often."""
    found = unigrams(base).where(F.col("n") >= max(1, least)).toPandas()
    return np.sort(found["word"].to_numpy(np.int64).view(np.uint64))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams; sums rounded, as SQL adds in another order."""
    found = backoff_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.round("log_prob", 4).alias("log_prob"), F.round("score", 6).alias("score"))


#: The same model in DuckDB by plain counting.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM t),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w UNION ALL SELECT NULL, count(*) FROM documents),
c2 AS (SELECT u, w, count(*) AS n FROM b GROUP BY u, w),
s AS (SELECT b.doc_id, CASE WHEN c2.n >= {MIN_COUNT} THEN ln(c2.n / h.n) ELSE ln({BACKOFF} * c1.n / (SELECT count(*) FROM t)) END AS x
  FROM b JOIN c2 ON b.w = c2.w AND b.u IS NOT DISTINCT FROM c2.u JOIN c1 ON b.w = c1.w JOIN c1 h ON b.u IS NOT DISTINCT FROM h.w),
g AS (SELECT doc_id, count(*) AS n_tokens, sum(x) AS log_prob FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(log_prob, 0), 4) AS log_prob, round(coalesce(log_prob / n_tokens, 0), 6) AS score FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
