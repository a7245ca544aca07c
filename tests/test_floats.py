"""Scalar conversions against NumPy, and the edge values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilepress.functions import floats as fl
from tilepress.functions import sizes

INF, NAN = float("inf"), float("nan")


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, float(np.float32(v))) for i, v in enumerate(values)], "i int, v double").select("i", F.col("v").cast("float").alias("v"))
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_e4m3_edges(spark):
    values = [NAN, INF, -INF, -0.0, 0.0, 7.75 / 512, 1.96875, 448, 1000, -1000, 2.0**-6, 2.0**-9]
    assert column(spark, values, fl.e4m3_encode) == [0x7E, 0x7E, 0xFE, 0x80, 0, 7, 0x40, 0x7E, 0x7E, 0xFE, 8, 1]


def test_e4m3_decodes_every_code(spark):
    got = [r[0] for r in spark.range(256).orderBy("id").select(fl.e4m3_decode(F.col("id").cast("int"))).collect()]
    want = []
    for c in range(256):
        e, m = (c >> 3) & 15, c & 7
        want.append((-1 if c > 127 else 1) * (m / 8 * 2.0**-6 if e == 0 else (1 + m / 8) * 2.0 ** (e - 7)))
    assert got == want


def test_e4m3_is_inverse_on_its_values(spark):
    codes = [c for c in range(256) if c & 127 <= 0x7E]
    rows = spark.createDataFrame([(c,) for c in codes], "c int")
    assert all(r.c == r.d for r in rows.select("c", fl.e4m3_encode(fl.e4m3_decode(F.col("c"))).alias("d")).collect())


def test_e2m1_ties_and_edges(spark):
    assert column(spark, [0.25, 0.75, 1.25, 1.75, 2.5, 3.5, 5.0], fl.e2m1_encode) == [0, 1, 2, 3, 4, 5, 6]
    assert column(spark, [INF, -INF, NAN, -0.0, 100, -0.3], fl.e2m1_encode) == [7, 15, 7, 8, 7, 9]


def test_nf4_against_float32_arg_min(spark):
    rng = np.random.default_rng(3)
    borders = np.array(fl.NF4_BORDERS, np.float32)
    values = np.concatenate([rng.uniform(-1.2, 1.2, 3000).astype(np.float32), borders, np.nextafter(borders, np.float32(2)), np.nextafter(borders, np.float32(-2)), np.array(fl.NF4_LEVELS, np.float32)])
    want = np.abs(values[:, None] - np.array(fl.NF4_LEVELS, np.float32)[None]).argmin(1)
    assert column(spark, values, fl.nf4_encode) == want.tolist()
    assert column(spark, [NAN, INF, -INF], fl.nf4_encode) == [7, 7, 7]


def _bf16(values):
    bits = values.view(np.uint32).astype(np.uint64)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(int).tolist()


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_half_formats_against_numpy(spark, seed):
    bits = np.random.default_rng(seed).integers(0, 2**32, 2000, dtype=np.uint32)
    values = bits.view(np.float32)
    values = np.concatenate([values[np.isfinite(values)], np.array([0.0, -0.0, 65504, 65519, 65520, 1e-8, 6e-8, 2.0**-14], np.float32)])
    with np.errstate(over="ignore"):
        assert column(spark, values, fl.fp16_encode) == values.astype(np.float16).view(np.uint16).astype(int).tolist()
    assert column(spark, values, fl.bf16_encode) == _bf16(values)


def test_half_formats_not_finite(spark):
    assert column(spark, [INF, -INF, NAN], fl.fp16_encode) == [0x7C00, 0xFC00, 0x7E00]
    assert column(spark, [INF, -INF, NAN], fl.bf16_encode) == [0x7F80, 0xFF80, 0x7FC0]
    got = [r[0] for r in spark.range(0, 65536, 7).orderBy("id").select(fl.fp16_decode(F.col("id").cast("int"))).collect()]
    want = np.arange(0, 65536, 7).astype(np.uint16).view(np.float16).astype(np.float32)
    assert np.array_equal(np.array(got, np.float32), want, equal_nan=True)


def test_counts_and_sizes():
    assert [sizes.topk_count(6, 0.5), sizes.topk_count(5, 0.4), sizes.topk_count(8, 0.0), sizes.topk_count(8, 0.01), sizes.topk_count(8, 1.0)] == [3, 2, 0, 1, 8]
    assert sizes.topk_count(5, 0.5) == 3  # half away from zero
    for ratio in (-0.1, 1.1, NAN):
        with pytest.raises(ValueError):
            sizes.topk_count(8, ratio)
    n = 4_194_304
    want = {"q8_0": 4_718_656, "q4_0": 2_621_504, "q2_k": 1_376_312, "q2_k_fast": 1_376_312, "bf16": 8_388_648, "fp16": 8_388_648, "fp8": 4_194_352, "fp4": 2_097_200, "mxfp8": 4_325_440, "mxfp4": 2_228_288, "nvfp4": 2_359_368, "nf4": 2_359_360, "nf4_dq": 2_162_760}
    assert {c: sizes.buffer_size(c, n) for c in want} == want
