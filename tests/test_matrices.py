"""Top-k goldens, factorization, compression plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilepress.functions import sizes
from tilepress.operators import blocks as bl
from tilepress.operators import lowrank, topk
from tilepress.plans.compress import CompressConfig, DecompressConfig, compress, decompress, read, write
from tilepress.sources import generators, packing

#: Matrices and the columns picked in each row, in rank order.
EXTRACT = ([[0.4, -9.3, 2.1, -5.2, 7.8, -1.0], [-6.6, 1.3, 8.4, -2.5, 0.7, 3.9], [4.2, -0.8, 5.1, -7.7, 2.6, 9.9]], 3, [[1, 4, 3], [2, 0, 5], [5, 3, 2]])
PACK = ([[1.0, -5.0, 0.2, 7.0, -3.0], [2.0, 4.0, -8.0, 0.5, 1.5], [-9.0, 0.1, 3.0, 2.0, -4.0], [6.0, -7.0, 8.0, -1.0, 0.3]], 2, [[3, 1], [2, 1], [0, 4], [2, 1]])
SEPARATE = [[1.0, -2.0, 3.0, -4.0, 5.0, -6.0, 7.0, -8.0], [-1.1, 2.2, -3.3, 4.4, -5.5, 6.6, -7.7, 8.8]]


def wide(spark, rows):
    return spark.createDataFrame([(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(rows)], "row int, vec array<float>")


def matrix(frame):
    return np.array([r.vec for r in frame.orderBy("row").collect()], np.float32)


@pytest.mark.parametrize("rows,k,want", [EXTRACT, PACK])
def test_goldens(spark, rows, k, want):
    a = wide(spark, rows)
    found = topk.extract(a, k)
    assert [[p.col for p in r.picks] for r in found.orderBy("row").collect()] == want
    long = topk.extract_long(bl.to_long(a), k).orderBy("row", "rank").collect()
    assert [r.col for r in long] == [c for r in want for c in r]
    dense = matrix(topk.decompress(found, len(rows[0])))
    assert ((dense != 0).sum(1) == k).all()
    data = packing.pack_topk(found, len(rows[0]))
    assert len(data) == sizes.topk_size(len(rows), len(rows[0]), k)
    assert packing.unpack_topk(spark, data, len(rows), len(rows[0]), k).collect() == found.orderBy("row").collect()
    for bad in ((data, len(rows) + 1, len(rows[0]), k), (data, len(rows), len(rows[0]), k - 1), (data[:-1], len(rows), len(rows[0]), k)):
        with pytest.raises(ValueError):
            packing.unpack_topk(spark, *bad)


@pytest.mark.parametrize("ratio", [0.0, 0.01, 1.0])
def test_separation_and_back(spark, ratio):
    k = sizes.topk_count(8, ratio)
    split = topk.separate(wide(spark, SEPARATE), k)
    assert ((matrix(split.select("row", "vec")) == 0).sum(1) == k).all()
    back = topk.apply(split.select("row", "vec"), split.select("row", "picks"))
    assert np.array_equal(matrix(back), np.array(SEPARATE, np.float32))


def test_ties_and_nan(spark):
    got = topk.extract(wide(spark, [[float("nan"), 2.0, -2.0, 1.0]]), 4).first().picks
    assert [p.col for p in got] == [1, 2, 3, 0]


def test_svd_recovers_low_rank(spark):
    a = generators.low_rank_matrix(spark, 120, 40, 6)
    x = matrix(a)
    f = lowrank.lowrank_svd(a, 40, 6)
    assert np.allclose(f.s, np.linalg.svd(x.astype(float))[1][:6], rtol=1e-4)
    u = matrix(f.u).astype(float)
    assert np.allclose(u.T @ u, np.eye(6), atol=1e-4)
    assert np.abs(matrix(lowrank.reconstruct(f.u, f.s, f.v)) - x).max() < 1e-2
    assert lowrank.lowrank_svd(generators.low_rank_matrix(spark, 5, 40, 3), 40, 64).v.shape == (40, 5)


def config(**more):
    return CompressConfig(rows=16, columns=64, **more)


@pytest.mark.parametrize(
    "more,size",
    [
        ({"only_format": "NF4"}, 200 + 48 + 64 + 512),
        ({"only_format": "NF4", "error_ratio": 0.05}, 200 + 48 + 64 + 512 + 8 + 6 * 16 * 3),
        ({"only_format": "NF4_DQ", "outlier_ratio": 0.1}, 200 + 48 + 16 + 512 + 8 + 6 * 16 * 6),
        ({}, 200 + 4096),
        ({"error_ratio": 0.5}, 200 + 4096),
        ({"ranks": 4}, 200 + 4 * (16 * 4 + 4 + 64 * 4)),
        ({"ranks": 4, "uv_format": "NF4", "s_format": "NF4_DQ", "error_ratio": 0.05, "outlier_ratio": 0.02}, None),
    ],
)
def test_plans(spark, tmp_path, more, size):
    a = generators.wave_matrix(spark, 16, 64, 0.013, 0.051, 0.05).cache()
    c = config(**more)
    m = compress(a, c)
    if size:
        assert m.packed_size() == size
    got = matrix(decompress(m, DecompressConfig(**{**c.__dict__, "ranks": c.rank})))
    bound = {"NONE": 1e-6, "NF4": 0.6, "NF4_DQ": 0.6}[c.only_format] if not c.rank else 1.0
    assert np.abs(got - matrix(a)).max() <= bound
    write(m, str(tmp_path / "m"))
    again = read(spark, str(tmp_path / "m"))
    assert again.layout() == m.layout() and np.abs(matrix(decompress(again)) - got).max() <= 1e-5


def test_error_correction_helps(spark):
    a = generators.wave_matrix(spark, 16, 64).cache()
    x = matrix(a)
    plain = np.abs(matrix(decompress(compress(a, config(only_format="NF4")))) - x).mean()
    better = np.abs(matrix(decompress(compress(a, config(only_format="NF4", error_ratio=0.2)))) - x).mean()
    assert better < plain


def test_rejections(spark):
    for bad in ({"only_format": "Q8_0"}, {"outlier_ratio": 1.5}, {"error_ratio": float("nan")}, {"ranks": -1}, {"ranks": 2, "niters": 0}):
        with pytest.raises(ValueError):
            config(**bad)
    with pytest.raises(ValueError):
        CompressConfig(rows=70_000, columns=4)
    a = generators.ramp_matrix(spark, 16, 64)
    m = compress(a, config(ranks=4, outlier_ratio=0.1))
    good = {**m.config.__dict__}
    for change in ({"ranks": 3}, {"ranks": 5}, {"columns": 63}, {"outlier_ratio": 0.01}, {"uv_format": "NF4"}):
        with pytest.raises(ValueError):
            decompress(m, DecompressConfig(**{**good, **change}))


def test_registry_matches_sql(spark):
    """A few queries against DuckDB on the smallest tables; the driver holds all of them."""
    import duckdb

    from tilepress.plans import registry

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("embeddings", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("nf4_codes", "mxfp4_roundtrip", "topk_separate", "q2_k_fast_codes", "section_layout", "packed_sizes"):
        got = registry.QUERIES[name](spark, sf).toPandas()
        want = db.sql(registry.SQL[name]).df()[list(got.columns)]
        key = list(got.columns)
        assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want[key].values.tolist())), name


def test_reconstruct_query_takes_the_whole_matrix(spark, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(3)
    x = (rng.standard_normal((50, 12)) @ rng.standard_normal((12, 64))).astype(np.float32)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.row, r.col): r.v for r in __spark_entry__.queries()["reconstruct_svd"](spark, str(tmp_path)).collect()}
    assert len(got) == 50 * 64 and max(abs(got[i, j] - x[i, j]) for i in range(50) for j in range(64)) < 1e-3
