"""Packed objects: flat buffers of all codecs, whole matrices, loading with bounds checks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilepress.functions import sizes
from tilepress.operators import blocks as bl
from tilepress.operators import kernels, q2k
from tilepress.plans import registry
from tilepress.plans.compress import CompressConfig, DecompressConfig, compress, decompress, header, load, pack, tiles
from tilepress.sources import generators, packing

f = np.float32


def coded_values(spark, codec, n):
    x = np.random.default_rng(n).uniform(-10, 10, n).astype(f)
    vector = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, v double").select("idx", F.col("v").cast("float").alias("v")).repartition(3)
    if codec.startswith("q2_k"):
        return q2k.encode(bl.vector_blocks(vector, q2k.SUPER), codec), q2k.decode
    return kernels.encode(bl.vector_blocks(vector, kernels.KERNELS[codec].size), codec), lambda c: kernels.decode(c, codec)


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("codec", list(sizes.STRUCT))
def test_flat_buffers(spark, codec):
    for n in (1, 300, 513):
        coded, decode = coded_values(spark, codec, n)
        data = packing.assemble(packing.flat_buffer(coded, codec, n))
        assert len(data) == sizes.buffer_size(codec, n)
        name, count, again = packing.load_flat(spark, data + b"beyond")
        assert (name, count) == (codec, n) and rows(decode(again)) == rows(decode(coded))
    for bad in (data[:-1], data[:20], b"\x63" + data[1:], data[:8] + struct.pack("<Q", 0) + data[16:], data[:8] + struct.pack("<Q", 2**62) + data[16:], data[:24] + b"\xff" * 8 + data[32:]):
        with pytest.raises(ValueError):
            packing.load_flat(spark, bad)


def test_segments_must_fit(spark):
    part = lambda *x: spark.createDataFrame([(a, bytearray(b)) for a, b in x], packing.SEGMENTS)
    assert packing.assemble(part((2, b"cd"), (0, b"ab"))) == b"abcd"
    for bad in (part((0, b"ab"), (3, b"d")), part((0, b"ab"), (1, b"b"))):
        with pytest.raises(ValueError):
            packing.assemble(bad)
    with pytest.raises(ValueError):
        packing.assemble(part((0, b"abcd")), most=3)


CASES = [{}, {"only_format": "NF4"}, {"only_format": "NF4_DQ", "outlier_ratio": 0.1, "error_ratio": 0.05}, {"ranks": 4}, {"ranks": 4, "uv_format": "NF4", "s_format": "NF4_DQ", "error_ratio": 0.05, "outlier_ratio": 0.02}]


def cells(frame):
    return np.array([r.vec for r in frame.orderBy("row").collect()], f)


@pytest.mark.parametrize("more", CASES)
def test_packed_matrix(spark, more):
    a = generators.wave_matrix(spark, 20, 50, 0.013, 0.051, 0.05).cache()
    c = CompressConfig(rows=20, columns=50, **more)
    with compress(a, c) as m:
        data = packing.assemble(pack(m))
        first = cells(decompress(m))
        assert len(data) == m.packed_size() and data[:200] == header(m)
    assert not m.held
    again = load(spark, data + b"beyond")
    assert again.layout() == m.layout()
    assert np.abs(cells(decompress(again, DecompressConfig(**{**c.__dict__, "ranks": c.rank}))) - first).max() <= 1e-5


def test_packed_matrix_is_checked(spark):
    a = generators.wave_matrix(spark, 20, 50)
    data = packing.assemble(pack(compress(a, CompressConfig(rows=20, columns=50, only_format="NF4", outlier_ratio=0.1))))
    direct, outlier = 48 + 3 * 24, 48 + 4 * 24

    def changed(at, form, *values):
        return data[:at] + struct.pack(form, *values) + data[at + struct.calcsize(form) :]

    bad = [
        data[:100], data[:-1], changed(0, "<H", 21), changed(4, "<I", 999), changed(direct, "<Q", 2**40), changed(direct + 8, "<Q", 2**63), changed(direct + 8, "<Q", 0), changed(direct + 16, "<B", 9),
        changed(direct + 16, "<B", 0), changed(direct + 16, "<B", 1), changed(outlier + 16, "<B", 1), changed(outlier, "<Q", 1), changed(40, "<I", 0), changed(20, "<h", 3), changed(32, "<i", 0),
    ]
    for k, x in enumerate(bad):
        with pytest.raises(ValueError):
            load(spark, x)
            pytest.fail(str(k))


def test_sizes_of_known_matrices(spark):
    """Bytes of packed matrices of 512 x 8192 cells."""
    want = [2_359_544, 4_875_520, 3_422_464, 5_938_440, 4_457_160, 627_104, 6_973_136, 3_143_080, 5_716_688, 8_232_664, 4_350_384, 200 + 4 * 512 * 8192]
    assert [r.packed_size for r in registry.matrix_sizes(spark, "").collect()] == want


def test_tall_matrices(spark):
    a = spark.range(65_537).select(F.col("id").cast("int").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.sin(F.col("id") * 4 + k)).cast("float")).alias("vec"))
    c = CompressConfig(rows=65_537, columns=4, only_format="NF4", error_ratio=0.25, tall=True)
    with compress(a, c) as m:
        assert m.packed_size() == sum(200 + 48 + 4 * -(-n * 4 // 64) + n * 2 + 8 + 6 * n for n in (65_535, 2))
        back = decompress(m).join(a.select("row", F.col("vec").alias("v")), "row")
        found = back.select(F.max(F.array_max(F.zip_with("vec", "v", lambda x, y: F.abs(x - y)))).alias("most"), F.count(F.lit(1)).alias("n")).first()
        assert found.n == 65_537 and found.most < 0.2
        with pytest.raises(ValueError):
            pack(m)
    parts = list(tiles(a, 65_537))
    assert [n for n, _ in parts] == [65_535, 2] and [r.row for r in parts[1][1].orderBy("row").collect()] == [0, 1]


NAMES = ("q2_k_codes", "q2_k_importance_codes", "q2_k_buffer", "q8_0_buffer", "nf4_dq_buffer", "fp16_buffer", "nvfp4_reloaded", "matrix_object_fp32", "matrix_object_nf4", "matrix_reloaded_nf4", "lowrank_moments", "lowrank_orthonormal", "compress_svd_nf4_whole_error", "matrix_sizes", "bit_values", "reconstruct_lowrank", "gram_matrix")


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("embeddings", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = db.sql(registry.SQL[name]).df()[list(got.columns)]
    assert len(got) > 0 and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
