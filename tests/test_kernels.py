"""Arrow kernels against the column expressions, and per-task sums against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilepress.functions import floats as fl
from tilepress.operators import kernels, lowrank
from tilepress.operators.codecs import CODECS

f = np.float32
ODD = np.array([0.0, -0.0, np.nan, np.inf, -np.inf, 1e-40, -1e-40, 3e38, 448, 464, 6, 2.0**-6, 2.0**-9, 0.5], f)


def blocks(spark, size):
    rng, rows = np.random.default_rng(1), []
    for i in range(60):
        v = (rng.standard_normal(size if i % 7 else max(1, size // 3)) * [1, 1e-3, 100, 1e30][i % 4]).astype(f)
        if i % 5 == 0:
            v[rng.integers(0, len(v), 3)] = rng.choice(ODD, 3)
        if i % 11 == 0:
            v[:] = 0
        rows.append((i, [float(x) for x in v]))
    return spark.createDataFrame(rows, "block_id long, vals array<float>").repartition(3)


def by_block(frame):
    return [str(r) for r in frame.orderBy("block_id").collect()]


@pytest.mark.parametrize("name", list(CODECS))
def test_kernels_are_the_columns(spark, name):
    codec, x = CODECS[name], blocks(spark, CODECS[name].size)
    coded = kernels.encode(x, name)
    assert coded.schema == codec.encode(x).schema and by_block(coded) == by_block(codec.encode(x))
    assert by_block(kernels.roundtrip(x, name)) == by_block(codec.roundtrip(x))
    assert by_block(kernels.decode(coded, name)) == by_block(codec.decode(coded))
    assert kernels.encode(x.where("false"), name).collect() == []


def test_kernels_move_no_rows(spark):
    for name in ("nf4", "mxfp8", "bf16"):
        assert "Exchange" not in kernels.encode(blocks(spark, CODECS[name].size).coalesce(1), name)._jdf.queryExecution().executedPlan().toString().replace("Exchange SinglePartition", "").split("Coalesce")[0]


def test_bits_of_nan():
    bits = np.array([0x7FC00000, 0xFFC00000, 0x7F800001, 0xFFABCDEF], np.uint32).view(f)
    assert kernels.bf16_encode(bits).tolist() == [0x7FC0, 0xFFC0, 0x7FC0, 0xFFEB]
    assert kernels.fp16_encode(bits).tolist() == [0x7E00, 0xFE00, 0x7E00, 0xFE00]


def test_wide_formats(spark):
    values = [0.0, -0.0, 1.0, -1 / 3, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), 2.0**-1022, 123456.789]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = rows.select("i", "v", fl.fp64_to_bits(F.col("v")).alias("bits")).select("i", "bits", fl.fp64_from_bits(F.col("bits")).alias("back")).orderBy("i").collect()
    assert [r.bits for r in got] == np.array(values).view(np.int64).tolist() and [str(r.back) for r in got] == [str(v) for v in values]
    singles = np.random.default_rng(2).integers(0, 2**32, 500, dtype=np.uint32)
    singles = singles[np.isfinite(singles.view(f))]
    back = spark.createDataFrame([(i, int(b)) for i, b in enumerate(singles)], "i int, b long").select("i", fl.fp32_from_bits(F.col("b")).alias("v")).select("i", "v", fl.fp32_to_bits(F.col("v")).alias("b")).orderBy("i").collect()
    assert [r.b for r in back] == singles.tolist()


def test_half_without_special_values(spark):
    codes = spark.range(0, 65536, 5).select(F.col("id").cast("int").alias("c"), fl.fp16_alt_decode(F.col("id").cast("int")).alias("v"))
    got = codes.select("c", "v", fl.fp16_alt_encode(F.col("v")).alias("again")).collect()
    assert all(r.c == r.again for r in got)
    for r in got:
        e, m = r.c >> 10 & 31, r.c & 1023
        assert abs(r.v) == (m / 1024 * 2.0**-14 if e == 0 else (1 + m / 1024) * 2.0 ** (e - 15))
    edge = spark.createDataFrame([(0, 200000.0), (1, float("inf")), (2, -1e30), (3, 65504.0), (4, 65520.0), (5, float("nan"))], "i int, v double")
    assert [r[0] for r in edge.orderBy("i").select(fl.fp16_alt_encode(F.col("v").cast("float"))).collect()] == [0x7FFF, 0x7FFF, 0xFFFF, 0x7BFF, 0x7C00, 0x7FFF]


def matrix(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row int, vec array<float>").repartition(3)


@pytest.mark.parametrize("most", [4096, 4])
def test_gram(spark, monkeypatch, most):
    monkeypatch.setattr(lowrank, "GRAM_COLUMNS", most)
    x = np.random.default_rng(3).standard_normal((70, 9)).astype(f)
    got = {(r.i, r.j): r.x for r in lowrank.gram(matrix(spark, x)).collect()}
    want = x.astype(float).T @ x
    assert len(got) == 45 and all(abs(v - want[k]) < 1e-4 for k, v in got.items())
    assert lowrank.gram(matrix(spark, x).where("false")).collect() == []


def test_long_reconstruction(spark):
    rng = np.random.default_rng(4)
    u, s, v = rng.standard_normal((20, 3)), rng.random(3), rng.standard_normal((6, 3))
    long = lambda m, a, b: spark.createDataFrame([(i, p, float(m[i, p])) for i in range(m.shape[0]) for p in range(3)], f"{a} int, {b} int, x double")
    weights = spark.createDataFrame([(p, float(s[p])) for p in range(3)], "p int, x double")
    got = {(r.row, r.col): r.x for r in lowrank.reconstruct_long(long(u, "row", "p"), weights, long(v, "col", "p").withColumn("col", F.col("col") * 10)).collect()}
    want = u @ np.diag(s) @ v.T
    assert len(got) == 120 and all(abs(got[i, 10 * j] - want[i, j]) < 1e-9 for i in range(20) for j in range(6))


@pytest.mark.parametrize("rows,columns", [(12, 50), (50, 12)])
def test_either_side_may_be_short(spark, rows, columns):
    x = np.random.default_rng(5).standard_normal((rows, columns)).astype(f)
    found = lowrank.lowrank_svd(matrix(spark, x), columns, 12, niter=8)
    u = np.array([r.vec for r in found.u.orderBy("row").collect()], float)
    assert np.allclose(found.s, np.linalg.svd(x.astype(float))[1], rtol=1e-4)
    assert np.allclose(u.T @ u, np.eye(12), atol=1e-4) and np.allclose(found.v.T @ found.v, np.eye(12), atol=1e-4)
    assert np.abs(u * found.s @ found.v.T - x).max() < 1e-3


def test_factorization_arguments(spark):
    x = matrix(spark, np.ones((4, 3)))
    for bad in ({"columns": 0, "rank": 2}, {"columns": 70_000, "rank": 2}, {"columns": 3, "rank": 2, "niter": -1}):
        with pytest.raises(ValueError):
            lowrank.lowrank_svd(x, **bad)
    with pytest.raises(ValueError):
        lowrank.lowrank_svd(x.where("false"), 3, 2)


def test_xorshift_rows_are_one_sequence(spark):
    from tilepress.sources.generators import xorshift_matrix, xorshift_values

    got = np.array([r.vec for r in xorshift_matrix(spark, 37, 11).repartition(4).orderBy("row").collect()], f)
    assert np.array_equal(got.ravel(), xorshift_values(37 * 11))


def test_latency():
    from tilepress.operators.metrics import latency

    calls = []
    found = latency(lambda: calls.append(1), warmup=2, runs=10)
    assert len(calls) == 12 and 0 <= found["min"] <= found["p50"] <= found["p95"] <= found["max"]
    with pytest.raises(ValueError):
        latency(lambda: None, runs=0)
