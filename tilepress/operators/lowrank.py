"""Randomized low-rank factorization of a wide matrix, and reconstruction.

Only n x k and k x k matrices reach the driver (n columns, at most 65,535; k the rank); rows stay distributed. Each pass over
the rows adds up partial products per task, which a second exchange adds up in groups before the driver sums the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 65_535
#: Cells up to which a matrix of more columns than rows is factorized by its rows, on the driver.
SHORT_CELLS = 1 << 22
#: Partial matrices that are summed by one task before the driver adds the rest.
FAN_IN = 32


@dataclass(frozen=True)
class Factors:
    """A is about U diag(S) V^T. u: DataFrame (row, vec of k); s: k values; v: n x k."""

    u: DataFrame
    s: np.ndarray
    v: np.ndarray

    def s_frame(self) -> DataFrame:
        return self.u.sparkSession.createDataFrame([(p, float(x)) for p, x in enumerate(self.s)], "p int, x float")

    def v_frame(self) -> DataFrame:
        rows = [(c, [float(x) for x in r]) for c, r in enumerate(self.v)]
        return self.u.sparkSession.createDataFrame(rows, "row int, vec array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sum_of(wide: DataFrame, part, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of part(rows as a matrix), a matrix of that shape."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py()).reshape(shape)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = wide.select("vec").mapInArrow(partial, "m binary")
    tasks = wide.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(merge, "m binary")
    out = np.zeros(shape)
    for r in parts.toLocalIterator():
        out += np.frombuffer(r.m).reshape(shape)
    return out


def _product(wide: DataFrame, right: np.ndarray) -> DataFrame:
    """(row, vec) of rows times a matrix."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = (_matrix(batch.column(1)) @ right).astype(np.float32)
                offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=["row", "vec"])

    kind = wide.schema["row"].dataType.simpleString()
    return wide.select("row", "vec").mapInArrow(times, f"row {kind}, vec array<float>")


def lowrank_svd(wide: DataFrame, columns: int, rank: int, niter: int = 2, seed: int = 1241) -> Factors:
    """Randomized subspace iteration. rank is clamped to 1..min(rows, columns); the largest component of each column of V is positive."""
    rows = wide.count()
    if columns < 1 or columns > MAX_COLUMNS or rows < 1 or niter < 0:
        raise ValueError("the matrix needs rows, 1 to 65535 columns and niter of 0 or more")
    k = max(1, min(rank, rows, columns))
    over = min(columns, rows, k + 10)  # a few more directions while iterating
    if rows < columns and rows * columns <= SHORT_CELLS:  # the short side is factorized: the rows, through A A^T
        return _svd_of_few_rows(wide, columns, k)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, over)))[0]
    for _ in range(niter + 1):
        basis = np.linalg.qr(_sum_of(wide, lambda x, b=basis: x.T @ (x @ b), (columns, over)))[0]
    gram = _sum_of(wide, lambda x, b=basis: (x @ b).T @ (x @ b), (over, over))
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(values)[::-1][:k]
    s = np.sqrt(np.maximum(values[top], 0))
    v = basis @ vectors[:, top]
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    v = v * np.where(sign == 0, 1, sign)
    inverse = np.where(s > 1e-12 * max(s.max(), 1e-300), 1 / np.maximum(s, 1e-300), 0.0)
    return Factors(_product(wide, v * inverse), s.astype(np.float32), v.astype(np.float32))


def _svd_of_few_rows(wide: DataFrame, columns: int, k: int) -> Factors:
    """Fewer rows than columns: the eigenvectors of A A^T, which is small, are one side of the factorization."""
    found = wide.select("row", "vec").toLocalIterator()  # at most SHORT_CELLS cells
    ids, cells = [], []
    for r in found:
        ids.append(r.row)
        cells.append(np.array(r.vec, np.float32))
    x = np.array(cells, np.float32).reshape(-1, columns).astype(np.float64)
    values, vectors = np.linalg.eigh(x @ x.T)
    top = np.argsort(values)[::-1][:k]
    s = np.sqrt(np.maximum(values[top], 0))
    inverse = np.where(s > 1e-12 * max(s.max(), 1e-300), 1 / np.maximum(s, 1e-300), 0.0)
    v = (x.T @ vectors[:, top]) * inverse
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    sign = np.where(sign == 0, 1, sign)
    u = vectors[:, top] * sign * (inverse > 0)
    kind = wide.schema["row"].dataType.simpleString()
    rows = [(i, [float(a) for a in r]) for i, r in zip(ids, u.astype(np.float32), strict=True)]
    return Factors(wide.sparkSession.createDataFrame(rows, f"row {kind}, vec array<float>"), s.astype(np.float32), (v * sign).astype(np.float32))


def reconstruct(u: DataFrame, s: np.ndarray, v: np.ndarray) -> DataFrame:
    """(row, vec) of U diag(S) V^T; S and V are small and travel with the task, U is scaled first."""
    return _product(u, (v.astype(np.float64) * s.astype(np.float64)).T)


def reconstruct_long(u: DataFrame, s: DataFrame, v: DataFrame) -> DataFrame:
    """(row, col, x) in double from long factors u(row, p, x), s(p, x), v(col, p, x); absent cells are 0.

    The cells of a row of U are gathered by row, so tasks are as many as partitions of rows, whatever the rank. S and V (at most
    65,535 columns of the rank) travel with the tasks.
    """
    weight = {r.p: float(r.x) for r in s.groupBy("p").agg(F.sum(F.col("x").cast("double")).alias("x")).toLocalIterator()}
    place = {p: k for k, p in enumerate(sorted(weight))}
    names = [r.col for r in v.select("col").distinct().orderBy("col").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError("more than 65535 columns")
    number, right = {c: k for k, c in enumerate(names)}, np.zeros((len(names), len(place)))
    for r in v.select("col", "p", "x").toLocalIterator():
        if r.p in place:
            right[number[r.col], place[r.p]] += float(r.x) * weight[r.p]

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.zeros((batch.num_rows, len(place)))
            for k, (ps, xs) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                some = [(place[p], x) for p, x in zip(ps.as_py(), xs.as_py(), strict=True) if p in place]
                if some:
                    np.add.at(left[k], [p for p, _ in some], [x for _, x in some])
            x = left @ right.T
            offsets = pa.array(np.arange(0, x.size + 1, max(len(names), 1), dtype=np.int32)[: batch.num_rows + 1])
            if len(names):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["row", "vec"])

    cells = u.groupBy("row").agg(F.collect_list(F.struct("p", F.col("x").cast("double").alias("x"))).alias("cells"))
    kind = u.schema["row"].dataType.simpleString()
    wide = cells.select("row", F.transform("cells", lambda c: c["p"]).alias("p"), F.transform("cells", lambda c: c["x"]).alias("x")).mapInArrow(times, f"row {kind}, vec array<double>")
    col = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("k") + 1) if names != list(range(len(names))) else F.col("k")
    return wide.select("row", F.posexplode("vec").alias("k", "x")).select("row", col.cast(v.schema["col"].dataType).alias("col"), "x")


#: Columns up to which a task holds its whole partial A^T A (128 MB).
GRAM_COLUMNS = 4096


def gram(wide: DataFrame) -> DataFrame:
    """(i, j, x) with i <= j of A^T A. Each task adds up the products of its rows as one matrix product and passes on a row of the
    upper half for each i; these are added up by i. Beyond GRAM_COLUMNS columns, where that does not fit a task, cells are summed
    one by one with partial aggregation."""
    first = wide.select(F.size("vec").alias("n")).first()
    if first is not None and first.n > GRAM_COLUMNS:
        at = wide.select("vec", F.posexplode("vec").alias("i", "a"))
        pairs = at.select("i", "a", F.posexplode(F.slice("vec", F.col("i") + 1, F.size("vec"))).alias("d", "b"))
        return pairs.groupBy("i", (F.col("i") + F.col("d")).alias("j")).agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("x"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            i, j = np.triu_indices(n)
            for k in range(0, len(i), 1 << 20):
                part = slice(k, k + (1 << 20))
                yield pa.RecordBatch.from_arrays([pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), pa.array(total[i[part], j[part]])], names=["i", "j", "x"])

    return wide.select("vec").mapInArrow(partial, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
