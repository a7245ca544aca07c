"""Packed binary forms: bytes of blocks as columns, and whole relocatable buffers for objects that fit one value."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepress.functions import floats as fl
from tilepress.functions import sizes
from tilepress.operators import q2k
from tilepress.operators.kernels import KERNELS

#: Magic and version of a quantized section, and the method numbers.
MAGIC, VERSION = 0x51544355, 1
METHODS = {"NONE": -1, "Q8_0": 0, "Q4_0": 1, "Q2_K": 2, "BF16": 3, "FP16": 4, "FP8": 5, "FP4": 6, "MXFP8": 7, "MXFP4": 8, "NVFP4": 9, "NF4_DQ": 10, "NF4": 11, "Q2_K_FAST": 12}
NIBBLES = {"q4_0", "fp4", "mxfp4", "nvfp4", "nf4", "nf4_dq"}


def byte_string(values: Column, width: int = 1) -> Column:
    """BINARY of integers, little endian, `width` bytes each."""

    def one(v: Column) -> Column:
        return F.concat(*[F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(width)])

    return F.unhex(F.array_join(F.transform(values, one), ""))


def nibble_string(codes: Column) -> Column:
    """BINARY of 4-bit codes, the even place in the high half; a missing last one is 0."""
    digits = F.array_join(F.transform(codes, lambda c: F.hex(c.bitwiseAND(F.lit(15)).cast("long"))), "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def pack_blocks(coded: DataFrame, codec: str) -> DataFrame:
    """(block_id, n, scale, data) with the bytes that the codec stores for each block."""
    if codec.startswith("q2_k"):
        scale = F.concat(byte_string(F.array("super_scale"), 2), byte_string(F.array("super_min"), 2), byte_string(F.col("scale_codes")))
        return coded.select("block_id", "n", scale.alias("scale"), q2k.pack_codes(F.col("codes")).alias("data"))
    codes = F.col("codes")
    width = 2 if codec in ("bf16", "fp16") else 1
    data = nibble_string(codes) if codec in NIBBLES else byte_string(codes, width)
    if codec in ("q8_0", "q4_0", "nf4"):
        scale = byte_string(F.array(fl.pack_bits(F.col("scale"), 8, 23)), 4)
    elif codec in ("mxfp8", "mxfp4"):
        scale = byte_string(F.array("exponent"))
    elif codec in ("nvfp4", "nf4_dq"):
        scale = byte_string(F.array("scale_code"))
    else:
        scale = F.lit(b"").cast("binary")
    return coded.select("block_id", F.size("codes").alias("n"), scale.alias("scale"), data.alias("data"))


@dataclass(frozen=True)
class QuantHeader:
    method: str
    elements: int
    blocks: int
    block_size: int = 64
    dq_scale: float = 0.0

    def pack(self) -> bytes:
        return struct.pack("<IHHiIQQQfI", MAGIC, VERSION, 0, METHODS[self.method], 0, self.elements, self.blocks, self.block_size, self.dq_scale, 0)

    @staticmethod
    def unpack(data: bytes) -> QuantHeader:
        """Raises ValueError unless magic, version, method, counts and the exact size are right."""
        if len(data) < sizes.CUDA_HEADER:
            raise ValueError("shorter than its header")
        magic, version, _, method, _, n, blocks, size, dq, _ = struct.unpack_from("<IHHiIQQQfI", data)
        names = {v: k for k, v in METHODS.items()}
        if magic != MAGIC or version != VERSION or names.get(method) not in ("NF4", "NF4_DQ"):
            raise ValueError("not a packed section")
        if n == 0 or size != 64 or blocks != sizes.blocks(n, 64) or len(data) != sizes.section_size(names[method], n):
            raise ValueError("counts and size do not agree")
        return QuantHeader(names[method], n, blocks, size, dq)


#: Block size, bytes of a block's scale and bits of a code of each flat codec; two-bit super-blocks are 84 bytes in one piece.
SHAPE = {"q8_0": (32, 4, 8), "q4_0": (32, 4, 4), "bf16": (256, 0, 16), "fp16": (256, 0, 16), "fp8": (256, 0, 8), "fp4": (256, 0, 4), "mxfp8": (32, 1, 8), "mxfp4": (32, 1, 4), "nvfp4": (16, 1, 4), "nf4": (64, 4, 4), "nf4_dq": (64, 1, 4), "q2_k": (256, 84, 0), "q2_k_fast": (256, 84, 0)}
#: The codecs with one scale for all blocks, and its column.
TENSOR = {"fp8": "scale", "fp4": "scale", "nvfp4": "tensor_scale", "nf4_dq": "dq_scale"}
#: A whole object as one value: bytes that the driver puts together at most. Larger ones stay tables of segments.
ONE_VALUE = 1 << 30
#: Bytes of it that the driver fetches at a time, more or less.
PIECE = 16 << 20
SEGMENTS = "offset_bytes long, bytes binary"


def _head(frame: DataFrame, at: int, data: bytes) -> DataFrame:
    return frame.sparkSession.createDataFrame([(at, bytearray(data))], SEGMENTS)


def _block_segments(coded: DataFrame, codec: str, elements: int, at: int) -> DataFrame:
    """(offset_bytes, bytes) of scales and data, placed by the block's number: no order and no collecting is needed."""
    size, width, bits = SHAPE[codec]
    rows, n = pack_blocks(coded, codec), sizes.blocks(elements, size)
    if not bits:
        return rows.select((F.lit(at) + F.col("block_id") * width).alias("offset_bytes"), F.concat("scale", "data").alias("bytes"))
    data = F.struct((F.lit(at + width * n) + F.col("block_id") * (size * bits // 8)).alias("offset_bytes"), F.col("data").alias("bytes"))
    scale = F.struct((F.lit(at) + F.col("block_id") * width).alias("offset_bytes"), F.col("scale").alias("bytes"))
    return rows.select(F.explode(F.array(scale, data) if width else F.array(data)).alias("s")).select("s.offset_bytes", "s.bytes")


def _struct(codec: str, n: int, tensor: float) -> bytes:
    """The codec's own struct; pointers are 0."""
    size = SHAPE[codec][0]
    blocks = sizes.blocks(n, size)
    if codec.startswith("q2_k"):
        return struct.pack("<QQIIQ", n, blocks * size, blocks, 0, 0)
    if codec in ("bf16", "fp16"):
        return struct.pack("<QQ", n, 0)
    if codec in ("fp8", "fp4"):
        return struct.pack("<QfIQ", n, tensor, 0, 0)
    if codec in ("nvfp4", "nf4_dq"):
        return struct.pack("<QQQfIQQ", n, blocks, size, tensor, 0, 0, 0)
    return struct.pack("<QQQQQ", n, blocks, size, 0, 0)


def flat_buffer(coded: DataFrame, codec: str, elements: int) -> DataFrame:
    """A flat codec's relocatable buffer as segments (offset_bytes, bytes): header, struct, scales, data."""
    if elements < 1:
        raise ValueError("a buffer needs elements")
    tensor = float(coded.select(TENSOR[codec]).first()[0]) if codec in TENSOR else 0.0
    head = struct.pack("<iIQQ", METHODS[codec.upper()], 0, elements, 0) + _struct(codec, elements, tensor)
    return _head(coded, 0, head).unionByName(_block_segments(coded, codec, elements, len(head)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a batch that follow one another as one: thousands of blocks become a few rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(0).to_numpy()
        order = np.argsort(at, kind="stable")
        at, parts = at[order], batch.column(1).take(pa.array(order))
        size = pc.binary_length(parts).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], at[1:] != (at + size)[:-1])))
        cuts = np.concatenate(([0], np.cumsum(size)))
        held = memoryview(b"".join(parts.to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array([held[a:b] for a, b in zip(cuts[first], [*cuts[first[1:]], cuts[-1]], strict=True)], pa.binary())], names=["offset_bytes", "bytes"])


def assemble(segments: DataFrame, most: int = ONE_VALUE) -> bytes:
    """The segments as one value. Raises ValueError beyond `most` bytes, and where they leave gaps or overlap.

    Tasks join what follows one another and the driver takes some PIECE bytes at a time, so neither the number of segments nor the
    size of a partition counts."""
    found = segments.agg(F.coalesce(F.max(F.col("offset_bytes") + F.octet_length("bytes")), F.lit(0)).alias("size"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("held")).first()
    if found.size > most or found.size != found.held:
        raise ValueError("segments do not make up one value")
    out = bytearray(found.size)
    for r in segments.select("offset_bytes", "bytes").mapInArrow(_runs, SEGMENTS).repartition(-(-found.size // PIECE) or 1).toLocalIterator():
        out[r.offset_bytes : r.offset_bytes + len(r.bytes)] = r.bytes
    return bytes(out)


def _coded_blocks(spark, data, codec: str, n: int, at: int, tensor: float) -> DataFrame:
    """The coded block table of scales and data that start at `at`; each task takes its own blocks out of the broadcast value."""
    size, width, bits = SHAPE[codec]
    blocks = sizes.blocks(n, size)
    held = spark.sparkContext.broadcast(data)  # one value, at most ONE_VALUE bytes
    kept = [(c, t) for c, t in KERNELS[codec].kept] if bits else [("super_scale", "int"), ("super_min", "int"), ("scale_codes", "array<int>")]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            own = np.minimum(size, n - ids * size)
            if not bits:
                rows = raw[at + ids[:, None] * 84 + np.arange(84)]
                packed, codes = rows[:, 20:], np.zeros((len(ids), 256), np.int32)
                place = np.array([j + l for j in (0, 128) for l in range(32)])  # noqa: E741
                for k in range(4):
                    codes[:, place + 32 * k] = packed >> (2 * k) & 3
                halves = np.ascontiguousarray(rows[:, :4]).view("<u2").astype(np.int32)
                scales = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(ids) + 1, 16, dtype=np.int32)), pa.array(rows[:, 4:20].astype(np.int32).ravel()))
                columns, mask = [pa.array(own, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), scales], np.ones(codes.shape, bool)
            else:
                first = at + width * blocks
                places = np.minimum(first + ids[:, None] * (size * bits // 8) + np.arange(size * bits // 8), len(raw) - 1)
                packed = raw[places]
                if bits == 4:
                    codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(ids), size).astype(np.int32)
                    codes = np.where(codes > 7, codes - 16, codes) if codec == "q4_0" else codes
                elif bits == 16:
                    codes = np.ascontiguousarray(packed).view("<u2").astype(np.int32)
                else:
                    codes = packed.view(np.int8).astype(np.int32) if codec == "q8_0" else packed.astype(np.int32)
                scale = np.ascontiguousarray(raw[at + ids[:, None] * width + np.arange(width)])
                values = {"scale": scale.view("<f4").ravel() if width == 4 else np.full(len(ids), np.float32(tensor)), "exponent": scale.view(np.int8).ravel(), "scale_code": scale.ravel(), "tensor_scale": np.full(len(ids), np.float32(tensor)), "dq_scale": np.full(len(ids), np.float32(tensor))}
                columns, mask = [pa.array(values[c], pa.float32() if t == "float" else pa.int32()) for c, t in kept], np.arange(size)[None] < own[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(mask.sum(1)))).astype(np.int32)), pa.array(codes[mask]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, lists], names=["block_id", *([] if bits else ["n"]), *[c for c, _ in kept], "codes"])

    schema = "block_id long, " + ("" if bits else "n int, ") + "".join(f"{c} {t}, " for c, t in kept) + "codes array<int>"
    return spark.range(blocks).mapInArrow(take, schema)


def load_flat(spark, data: bytes) -> tuple[str, int, DataFrame]:
    """(codec, elements, coded block table) of a flat codec's buffer. Raises ValueError unless method, counts and size agree; bytes
    beyond the buffer are passed over."""
    if len(data) < sizes.BUFFER_HEADER:
        raise ValueError("shorter than its header")
    method, _, n, _ = struct.unpack_from("<iIQQ", data)
    codec = {v: k.lower() for k, v in METHODS.items() if k != "NONE"}.get(method)
    if codec is None or n < 1 or n > 8 * len(data) or len(data) < sizes.buffer_size(codec, n):
        raise ValueError("method, counts and size do not agree")
    at = sizes.BUFFER_HEADER + sizes.STRUCT[codec]
    tensor = struct.unpack_from("<f", data, sizes.BUFFER_HEADER + (8 if codec in ("fp8", "fp4") else 24))[0] if codec in TENSOR else 0.0
    if bytes(data[sizes.BUFFER_HEADER : at]) != _struct(codec, n, tensor):
        raise ValueError("the struct does not agree with the header")
    return codec, n, _coded_blocks(spark, data, codec, n, at, tensor)


def section_segments(coded: DataFrame, method: str, elements: int, at: int = 0) -> DataFrame:
    """One NF4 or NF4_DQ section from byte `at` on, as segments."""
    dq = float(coded.select("dq_scale").first()[0]) if method == "NF4_DQ" else 0.0
    head = QuantHeader(method, elements, sizes.blocks(elements, 64), 64, dq).pack()
    return _head(coded, at, head).unionByName(_block_segments(coded, method.lower(), elements, at + len(head)))


def pack_quantized(coded: DataFrame, method: str, elements: int) -> bytes:
    """One NF4 or NF4_DQ section as one value."""
    return assemble(section_segments(coded, method, elements))


def unpack_quantized(spark, data: bytes) -> DataFrame:
    """The coded block table of a packed section, ready for decoding."""
    head = QuantHeader.unpack(data)
    return _coded_blocks(spark, data, head.method.lower(), head.elements, sizes.CUDA_HEADER, head.dq_scale)


def topk_segments(sparse: DataFrame, rows: int, columns: int, k: int, at: int = 0) -> DataFrame:
    """(row, picks) with rows 0..rows-1 and k picks each: header, 16-bit columns, float32 values, as segments from byte `at` on.
    The header has the low 16 bits of the rows."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, parts = [], []
            for row, picks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(picks) != k or not 0 <= row < rows:
                    raise ValueError("rows need k picks each")
                first = at + sizes.TOPK_HEADER
                places += [first + 2 * k * row, first + 2 * k * rows + 4 * k * row]
                parts += [np.array([p["col"] for p in picks], "<u2").tobytes(), np.array([p["v"] for p in picks], "<f4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(parts, pa.binary())], names=["offset_bytes", "bytes"])

    head = _head(sparse, at, struct.pack("<HHHH", rows % 65_536, columns, k, 0))
    return head if k == 0 else head.unionByName(sparse.select("row", "picks").mapInArrow(put, SEGMENTS))


def pack_topk(sparse: DataFrame, columns: int) -> bytes:
    """(row, picks) as one value."""
    found = sparse.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("picks")), F.lit(0)).alias("k")).first()
    if found.rows > 65_535:
        raise ValueError("a value of its own tells 65535 rows at most")
    return assemble(topk_segments(sparse, found.rows, columns, found.k))


def unpack_topk(spark, data: bytes, rows: int, columns: int, capacity: int) -> DataFrame:
    """Raises ValueError where dimensions, capacity or size do not fit."""
    if len(data) < sizes.TOPK_HEADER:
        raise ValueError("shorter than its header")
    r, c, k, _ = struct.unpack_from("<HHHH", data)
    if (r, c) != (rows % 65_536, columns) or not rows or not c or k > c or k > capacity or len(data) != sizes.topk_size(rows, c, k):
        raise ValueError("header does not fit")
    held = spark.sparkContext.broadcast(data)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = np.frombuffer(held.value, "<u2", rows * k, sizes.TOPK_HEADER).reshape(rows, k)
        vals = np.frombuffer(held.value, "<f4", rows * k, sizes.TOPK_HEADER + 2 * rows * k).reshape(rows, k)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            offsets = pa.array(np.arange(0, len(ids) * k + 1, k, dtype=np.int32) if k else np.zeros(len(ids) + 1, np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(cols[ids].ravel().astype(np.int32)), pa.array(vals[ids].ravel())], names=["col", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.ListArray.from_arrays(offsets, pairs)], names=["row", "picks"])

    return spark.range(rows).mapInArrow(take, "row int, picks array<struct<col:int,v:float>>")


def dense_segments(wide: DataFrame, width: int, at: int = 0) -> DataFrame:
    """(row, vec) of `width` float32 each, row after row, as segments from byte `at` on."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.array(x.as_py(), "<f4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(at + 4 * width * batch.column(0).to_numpy().astype(np.int64)), pa.array(parts, pa.binary())], names=["offset_bytes", "bytes"])

    return wide.select("row", "vec").mapInArrow(put, SEGMENTS)


def unpack_dense(spark, data: bytes, rows: int, width: int) -> DataFrame:
    if len(data) != 4 * rows * width:
        raise ValueError("size does not fit the shape")
    held = spark.sparkContext.broadcast(data)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(held.value, "<f4").reshape(rows, width)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            offsets = pa.array(np.arange(0, len(ids) * width + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(cells[ids].ravel()))], names=["row", "vec"])

    return spark.range(rows).mapInArrow(take, "row int, vec array<float>")


__all__ = ["QuantHeader", "assemble", "byte_string", "dense_segments", "flat_buffer", "load_flat", "nibble_string", "pack_blocks", "pack_quantized", "pack_topk", "section_segments", "topk_segments", "unpack_dense", "unpack_quantized", "unpack_topk"]
