"""Codecs against a NumPy float32 model, packing, streams and the two-bit search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilepress.functions import floats as fl
from tilepress.functions import sizes
from tilepress.operators import blocks as bl
from tilepress.operators import metrics, q2k
from tilepress.operators.codecs import CODECS
from tilepress.sources import packing
from tilepress.sources.generators import uniform_vector
from tilepress.streaming.codecs import encode_stream

f = np.float32


def vector(spark, values):
    return spark.createDataFrame([(i, float(f(v))) for i, v in enumerate(values)], "idx long, v double").select("idx", F.col("v").cast("float").alias("v"))


def decoded(spark, name, values):
    c = CODECS[name]
    rows = c.decode(c.encode(bl.vector_blocks(vector(spark, values), c.size))).orderBy("block_id").collect()
    return np.concatenate([np.array(r.vals, f) for r in rows])


def rows(spark, name, values):
    c = CODECS[name]
    return c.encode(bl.vector_blocks(vector(spark, values), c.size)).orderBy("block_id").collect()


def test_edges(spark):
    r = rows(spark, "nf4", np.zeros(64))[0]
    assert r.scale == 1 and set(r.codes) == {7}
    r = rows(spark, "q8_0", np.zeros(32))[0]
    assert r.scale == 0 and set(r.codes) == {0}
    assert rows(spark, "q8_0", [127, 0.5, 1.5, 2.5] + [0] * 28)[0].codes[:4] == [127, 0, 2, 2]
    assert [len(r.codes) for r in rows(spark, "nf4", range(65))] == [64, 1]
    assert rows(spark, "nf4", [np.nan, np.inf, -np.inf, 2.0])[0].codes == [7, 7, 7, 15]


@pytest.mark.parametrize("name,size,top", [("q8_0", 32, 127), ("q4_0", 32, 7)])
def test_integer_model(spark, name, size, top):
    x = np.random.default_rng(1).uniform(-10, 10, 100).astype(f)
    want = []
    for b in range(0, 100, size):
        v = x[b : b + size]
        s = f(np.abs(v).max() / f(top))
        want.append(s * np.clip(np.rint(v * f(f(1) / s)), -top, top).astype(f))
    assert np.array_equal(decoded(spark, name, x), np.concatenate(want))


@pytest.mark.parametrize("name", list(CODECS))
def test_error_within_half_a_step(spark, name):
    x = np.random.default_rng(2).uniform(-10, 10, 700).astype(f)
    most = {"q8_0": 0.04, "q4_0": 0.75, "bf16": 0.04, "fp16": 0.005, "fp8": 0.7, "fp4": 1.8, "mxfp8": 0.8, "mxfp4": 2.7, "nvfp4": 2.5, "nf4": 1.6, "nf4_dq": 2.2}[name]
    assert np.abs(decoded(spark, name, x) - x).max() <= most


def test_blocks_straddle_rows(spark):
    wide = spark.createDataFrame([(r, [float(r * 50 + c) for c in range(50)]) for r in range(3)], "row int, vec array<float>")
    got = {r.block_id: list(r.vals) for r in bl.matrix_blocks(wide, 50, 64).collect()}
    assert got == {0: [float(i) for i in range(64)], 1: [float(i) for i in range(64, 128)], 2: [float(i) for i in range(128, 150)]}
    even = bl.matrix_blocks(wide.select("row", F.slice("vec", 1, 48).alias("vec")), 48, 16)
    assert "Exchange" not in even._jdf.queryExecution().executedPlan().toString()


def test_encoding_moves_no_rows(spark):
    wide = spark.range(4).select(F.col("id").cast("int").alias("row"), F.array_repeat(F.lit(1.5).cast("float"), 64).alias("vec"))
    plan = CODECS["nf4"].encode(bl.matrix_blocks(wide, 64, 64))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def _search_model(x):
    """One sub-block, element by element in float32."""
    w = np.abs(x)
    low, high = min(x), max(x)
    total, first = w[0], f(w[0] * x[0])
    for i in range(1, 16):
        total, first = f(total + w[i]), f(first + f(w[i] * x[i]))
    low = min(low, f(0))
    if low == high:
        return f(0), low

    def codes(inv):
        return [f(min(3, max(0, np.rint(f(inv * f(v - low)))))) for v in x]

    def error(s, m, c):
        out = f(0)
        for i in range(16):
            out = f(out + f(w[i] * abs(f(f(f(s * c[i]) + m) - x[i]))))
        return out

    inv = f(f(3) / f(high - low))
    scale = f(f(1) / inv)
    best = error(scale, low, codes(inv))
    for k in range(16):
        c = codes(f(f(f(f(-0.5) + f(f(0.1) * f(k))) + f(3)) / f(high - low)))
        l1 = l2 = lx = f(0)
        for i in range(16):
            wl = f(w[i] * c[i])
            l1, l2, lx = f(l1 + wl), f(l2 + f(wl * c[i])), f(lx + f(wl * x[i]))
        det = f(f(total * l2) - f(l1 * l1))
        if det > 0:
            s = f(f(f(total * lx) - f(first * l1)) / det)
            m = f(f(f(l2 * first) - f(l1 * lx)) / det)
            if m > 0:
                m, s = f(0), f(lx / l2)
            e = error(s, m, c)
            if e < best:
                best, scale, low = e, s, m
    return scale, low


def test_search_against_sequential_model():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(-10, 10, (60, 16)), rng.uniform(1, 2, (10, 16)), np.zeros((1, 16)), np.full((1, 16), -3.0)]).astype(f)
    scale, low = q2k.search(x, np.abs(x))
    for i in range(len(x)):
        assert (scale[i], low[i]) == _search_model(list(x[i])), i


@pytest.mark.parametrize("method", ["q2_k", "q2_k_fast"])
def test_q2k_roundtrip(spark, method):
    x = np.random.default_rng(5).uniform(-10, 10, 300).astype(f)
    coded = q2k.encode(bl.vector_blocks(vector(spark, x), q2k.SUPER), method)
    back = np.concatenate([np.array(r.vals, f) for r in q2k.decode(coded).orderBy("block_id").collect()])
    assert len(back) == 300 and np.abs(back - x).max() < 6.5 and np.abs(back - x).mean() < 2.2
    parts = packing.pack_blocks(coded, method).collect()
    assert all(len(r.scale) + len(r.data) == 84 for r in parts)
    with pytest.raises(ValueError):
        q2k.encode(bl.vector_blocks(vector(spark, x), q2k.SUPER), "q2_k_importance")


@pytest.mark.parametrize("method", ["NF4", "NF4_DQ"])
def test_packed_section(spark, method):
    x = np.random.default_rng(6).uniform(-1, 1, 131).astype(f)
    c = CODECS[method.lower()]
    coded = c.encode(bl.vector_blocks(vector(spark, x), 64))
    data = packing.pack_quantized(coded, method, 131)
    assert len(data) == sizes.section_size(method, 131)
    again = c.decode(packing.unpack_quantized(spark, data)).orderBy("block_id").collect()
    first = c.decode(coded).orderBy("block_id").collect()
    assert [r.vals for r in again] == [r.vals for r in first]
    for bad in (data[:-1], data + b"\0", b"\0" + data[1:], data[:30]):
        with pytest.raises(ValueError):
            packing.QuantHeader.unpack(bad)


def test_metrics_and_generator(spark):
    v = uniform_vector(spark, 1000)
    assert v.collect() == uniform_vector(spark, 1000).repartition(3).orderBy("idx").collect()
    m = metrics.measure(v.withColumn("decoded", (F.col("v") + fl.f32(1)).cast("float"))).first()
    assert m.n == 1000 and abs(m.mae - 1) < 1e-5 and abs(m.max_abs - 1) < 1e-5


def test_stream(spark, tmp_path):
    c = CODECS["nf4"]
    blocks = bl.vector_blocks(uniform_vector(spark, 640), 64)
    blocks.write.parquet(str(tmp_path / "in"))
    coded = encode_stream(spark.readStream.schema(blocks.schema).parquet(str(tmp_path / "in")), "nf4")
    q = coded.writeStream.format("memory").queryName("coded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("coded").collect()) == sorted(c.encode(blocks).collect())
    with pytest.raises(ValueError):
        encode_stream(blocks, "fp8")
