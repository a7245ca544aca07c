"""Queries over matrices of more rows than the 16 bits of a packed header tell."""

import struct

import pytest
from pyspark.sql import functions as F

from tilepress.plans import registry
from tilepress.plans.compress import CompressConfig, compress, load, pack
from tilepress.sources import packing

ROWS = 65_600


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    import duckdb

    path = tmp_path_factory.mktemp("tall")
    duckdb.sql(f"COPY (SELECT vec_id + 500 * k AS vec_id, embedding, label FROM '/root/testdata/sf0.001/embeddings.parquet', range(132) t(k) WHERE vec_id + 500 * k < {ROWS}) TO '{path}/embeddings.parquet' (FORMAT parquet)")
    return path


NAMES = ("matrix_object_fp32", "matrix_object_nf4", "matrix_reloaded_fp32", "matrix_reloaded_nf4", "matrix_reloaded_nf4_dq", "matrix_reloaded_outlier_error_nf4", "section_layout")


@pytest.mark.parametrize("name", NAMES)
def test_tall_queries_match_sql(spark, tall, tmp_path, name):
    import duckdb

    registry.QUERIES[name](spark, str(tall)).write.parquet(f"{tmp_path}/got")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tall}/embeddings.parquet'")
    db.execute(f"CREATE VIEW got AS SELECT * FROM '{tmp_path}/got/*.parquet'")
    db.execute(f"CREATE TABLE want AS {registry.SQL[name]}")
    columns = ", ".join(c[0] for c in db.execute("DESCRIBE want").fetchall())
    assert db.execute("SELECT count(*) FROM want").fetchall()[0][0] > 0
    for a, b in (("got", "want"), ("want", "got")):
        assert db.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchall() == [(0,)]


def test_whole_objects_are_checked(spark):
    a = spark.range(65_537).select(F.col("id").cast("int").alias("row"), F.array(F.col("id").cast("float"), F.sin("id").cast("float")).alias("vec"))
    with compress(a, CompressConfig(rows=65_537, columns=2, only_format="NF4", outlier_ratio=0.5, tall=True)) as m:
        data = packing.assemble(pack(m, whole=True))
        again = load(spark, data)
        assert len(data) == m.packed_size(whole=True) and again.config.rows == 65_537 and again.layout() == m.layout() and struct.unpack_from("<HHI", data) == (1, 2, 2 * 65_537)
    for bad in (struct.pack("<HHI", 2, 2, 2 * 65_537), struct.pack("<HHI", 1, 2, 2), struct.pack("<HHI", 1, 2, 2 * 131_073), struct.pack("<HHI", 1, 0, 2 * 65_537)):
        with pytest.raises(ValueError):
            load(spark, bad + data[8:])


@pytest.mark.parametrize("form", ["NF4", "NF4_DQ"])
def test_driver_takes_few_segments(spark, tall, monkeypatch, form):
    """Of some 131,000 segments of a packed matrix the driver fetches joined ones only."""
    wide, config = registry._config(spark, str(tall), only_format=form)
    fetched, plain = [], type(wide).toLocalIterator

    def counted(self, *more):
        for r in plain(self, *more):
            fetched.append(len(r.bytes))
            yield r

    monkeypatch.setattr(type(wide), "toLocalIterator", counted)
    monkeypatch.setattr(packing, "PIECE", 1 << 20)
    with compress(wide, config) as m:
        parts = pack(m, whole=True)
        data = packing.assemble(parts)
        want = b"".join(bytes(r.bytes) for r in parts.orderBy("offset_bytes").collect())
    assert data == want and len(data) == m.packed_size(whole=True) and sum(fetched) == len(data)
    assert len(fetched) < 200


def test_segments_of_a_batch_are_joined():
    import pyarrow as pa

    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.int64()), pa.array([b for _, b in x], pa.binary())], names=["offset_bytes", "bytes"])
    some = batch((7, b"h"), (0, b"ab"), (9, b""), (4, b"efg"), (2**33, b"z"), (2, b"c"))
    found = [(r["offset_bytes"], r["bytes"]) for b in packing._runs([batch(), some, batch((3, b"d"))]) for r in b.to_pylist()]
    assert found == [(0, b"abc"), (4, b"efgh"), (9, b""), (2**33, b"z"), (3, b"d")]
