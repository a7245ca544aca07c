"""The block codecs over Arrow batches: all blocks of a batch at once in float32, the same results as the column expressions.

Column expressions over arrays are interpreted value by value; these kernels are some ten times faster and move no rows either.
They also see the bits of NaN: BF16 keeps its high bits and sets the quiet bit, FP16 keeps its sign.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilepress.functions import floats as fl

_F = np.float32
_NF4_LEVELS, _NF4_BORDERS = np.array(fl.NF4_LEVELS, _F), np.array(fl.NF4_BORDERS, _F)
_E2M1_LEVELS = np.array(fl.E2M1_LEVELS, _F)
_E2M1_BORDERS = (_E2M1_LEVELS[1:] + _E2M1_LEVELS[:-1]) / _F(2)


def sanitize(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, _F(0))


def absmax(x: np.ndarray) -> np.ndarray:
    return np.abs(sanitize(x)).max(1)


def e4m3_encode(x: np.ndarray) -> np.ndarray:
    a = np.where(np.isfinite(x), np.minimum(np.abs(x), _F(fl.E4M3_MAX)), _F(fl.E4M3_MAX)).astype(np.float64)
    exponent = np.maximum(np.frexp(a)[1] - 1, -6)
    code = np.where(a < 2.0**-6, np.minimum(np.rint(a * 512), 7), (exponent + 7) * 8 + np.rint((np.ldexp(a, -exponent) - 1) * 8))
    return code.astype(np.int32) + np.where(np.signbit(x) & ~np.isnan(x), 128, 0).astype(np.int32)


def e4m3_decode(code: np.ndarray) -> np.ndarray:
    field, m = code >> 3 & 15, (code & 7) / 8
    return (np.where(code >= 128, -1.0, 1.0) * np.where(field == 0, m * 2.0**-6, np.ldexp(1 + m, field - 7))).astype(_F)


def e2m1_encode(x: np.ndarray) -> np.ndarray:
    a = np.where(np.isfinite(x), np.abs(x), _F(fl.E2M1_MAX))
    return np.searchsorted(_E2M1_BORDERS, a).astype(np.int32) + np.where(np.signbit(x) & ~np.isnan(x), 8, 0).astype(np.int32)


def e2m1_decode(code: np.ndarray) -> np.ndarray:
    return np.where(code >= 8, _F(-1), _F(1)) * _E2M1_LEVELS[code & 7]


def nf4_encode(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(_NF4_BORDERS, sanitize(x)).astype(np.int32)


def nf4_decode(code: np.ndarray) -> np.ndarray:
    return _NF4_LEVELS[code]


def bf16_encode(x: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(x, _F).view(np.uint32).astype(np.int64)
    return np.where(np.isnan(x), bits >> 16 | 0x40, (bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype(np.int32)


def bf16_decode(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint32) << np.uint32(16)).view(_F)


def fp16_encode(x: np.ndarray) -> np.ndarray:
    code = x.astype(np.float16).view(np.uint16).astype(np.int32)
    return np.where(np.isnan(x), np.where(np.signbit(x), 0xFE00, 0x7E00), code).astype(np.int32)


def fp16_decode(code: np.ndarray) -> np.ndarray:
    return code.astype(np.uint16).view(np.float16).astype(_F)


@dataclass(frozen=True)
class Kernel:
    """fit: (blocks as rows, tensor-wide maximum) -> kept columns, each one value per block, and what `code` takes. value: (kept
    columns, levels) -> decoded. tensor: whether fit takes the largest finite magnitude of all blocks."""

    name: str
    size: int
    fit: Callable[[np.ndarray, np.float32], tuple[dict[str, np.ndarray], np.ndarray]]
    code: Callable[[np.ndarray], np.ndarray]
    level: Callable[[np.ndarray], np.ndarray]
    factor: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None
    kept: tuple[tuple[str, str], ...] = ()
    tensor: bool = False

    def encoded(self, x: np.ndarray, top: np.float32) -> tuple[dict[str, np.ndarray], np.ndarray]:
        with np.errstate(all="ignore"):
            kept, scaled = self.fit(x, top)
            return kept, self.code(scaled)

    def decoded(self, kept: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            value = self.level(codes).astype(_F)
            return value if self.factor is None else self.factor(kept)[:, None] * value


def _integer(name: str, most: int) -> Kernel:
    def fit(x, top):
        scale = absmax(x) / _F(most)
        return {"scale": scale}, x * np.where(scale == 0, _F(0), _F(1) / scale)[:, None]

    return Kernel(name, 32, fit, lambda v: np.clip(np.rint(sanitize(v)), -most, most).astype(np.int32), lambda c: c, lambda k: k["scale"], (("scale", "float"),))


def _tensor_float(name: str, most: float, encode, decode) -> Kernel:
    def fit(x, top):
        scale = _F(1) if top == 0 else _F(top / _F(most))
        return {"scale": np.full(len(x), scale)}, x * (_F(1) / scale)

    return Kernel(name, 256, fit, encode, decode, lambda k: k["scale"], (("scale", "float"),), True)


def _micro(name: str, most: float, encode, decode) -> Kernel:
    def fit(x, top):
        target = absmax(x) / _F(most)
        power = np.ceil(np.log2(np.where(target > 0, target, _F(1)).astype(np.float64)).astype(_F)).astype(np.int32)
        power = (power + 128) % 256 - 128  # as an 8-bit integer
        return {"exponent": power}, x * np.ldexp(1.0, -power).astype(_F)[:, None]

    return Kernel(name, 32, fit, encode, decode, lambda k: np.ldexp(1.0, k["exponent"]).astype(_F), (("exponent", "int"),))


def _nvfp4() -> Kernel:
    def fit(x, top):
        tensor = _F(1) if top == 0 else _F(top / _F(fl.E2M1_MAX))
        target = absmax(x / tensor) / _F(fl.E2M1_MAX)
        code = e4m3_encode(np.where(target > 0, target, _F(1)))
        return {"tensor_scale": np.full(len(x), tensor), "scale_code": code}, x * (_F(1) / tensor) * (_F(1) / e4m3_decode(code))[:, None]

    return Kernel("nvfp4", 16, fit, e2m1_encode, e2m1_decode, lambda k: k["tensor_scale"] * e4m3_decode(k["scale_code"]), (("tensor_scale", "float"), ("scale_code", "int")), True)


def _nf4() -> Kernel:
    def fit(x, top):
        most = absmax(x)
        scale = np.where(most > 0, most, _F(1))
        return {"scale": scale}, x * (_F(1) / scale)[:, None]

    return Kernel("nf4", 64, fit, nf4_encode, nf4_decode, lambda k: k["scale"], (("scale", "float"),))


def _nf4_dq() -> Kernel:
    def block(kept):
        found = kept["dq_scale"] * e4m3_decode(kept["scale_code"])
        return np.where((found == 0) | ~np.isfinite(found), _F(1), found)

    def fit(x, top):
        most = absmax(x)
        dq = _F((top if top > 0 else _F(1)) / _F(fl.E4M3_MAX))
        dq = _F(1) if dq == 0 else dq
        kept = {"dq_scale": np.full(len(x), dq), "scale_code": e4m3_encode(np.where(most > 0, most, _F(1)) / dq)}
        return kept, x * (_F(1) / block(kept))[:, None]

    return Kernel("nf4_dq", 64, fit, nf4_encode, nf4_decode, block, (("dq_scale", "float"), ("scale_code", "int")), True)


KERNELS = {
    k.name: k
    for k in (
        _integer("q8_0", 127),
        _integer("q4_0", 7),
        Kernel("bf16", 256, lambda x, top: ({}, x), bf16_encode, bf16_decode),
        Kernel("fp16", 256, lambda x, top: ({}, x), fp16_encode, fp16_decode),
        _tensor_float("fp8", fl.E4M3_MAX, e4m3_encode, e4m3_decode),
        _tensor_float("fp4", fl.E2M1_MAX, e2m1_encode, e2m1_decode),
        _micro("mxfp8", fl.E4M3_MAX, e4m3_encode, e4m3_decode),
        _micro("mxfp4", fl.E2M1_MAX, e2m1_encode, e2m1_decode),
        _nvfp4(),
        _nf4(),
        _nf4_dq(),
    )
}


def filled(column: pa.Array, size: int, kind=_F) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a column as rows of `size`, short ones filled with zeros, and which places are their own."""
    own = np.arange(size)[None] < np.diff(column.offsets.to_numpy())[:, None]
    out = np.zeros(own.shape, kind)
    out[own] = column.flatten().to_numpy(zero_copy_only=False)
    return out, own


def _lists(x: np.ndarray, own: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(own.sum(1)))).astype(np.int32)), pa.array(x[own]))


def _with_top(blocks: DataFrame, kernel: Kernel) -> DataFrame:
    """block_id, vals, and top: the largest finite magnitude of all blocks, from each task's own, as one broadcast row."""
    blocks = blocks.select("block_id", F.col("vals").cast("array<float>").alias("vals"))
    if not kernel.tensor:
        return blocks.withColumn("top", fl.f32(0))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = _F(0)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            most = max(most, np.abs(sanitize(x)).max(initial=_F(0)))
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.float32())], names=["top"])

    tops = blocks.select("vals").mapInArrow(largest, "top float")
    return blocks.crossJoin(F.broadcast(tops.agg(F.coalesce(F.max("top"), fl.f32(0)).alias("top"))))


def _run(blocks: DataFrame, codec: str, codes: bool, decoded: bool) -> DataFrame:
    kernel = KERNELS[codec]
    names = ["block_id", *(["vals"] if decoded else [n for n, _ in kernel.kept]), *(["codes"] if codes else []), *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = filled(batch.column(1), kernel.size)
            kept, code = kernel.encoded(x, batch.column(2)[0].as_py() and _F(batch.column(2)[0].as_py()) or _F(0))
            out = [batch.column(0)]
            out += [batch.column(1)] if decoded else [pa.array(kept[n], pa.float32() if t == "float" else pa.int32()) for n, t in kernel.kept]
            out += [_lists(code, own)] if codes else []
            out += [_lists(kernel.decoded(kept, code), own)] if decoded else []
            yield pa.RecordBatch.from_arrays(out, names=names)

    types = {"vals": "array<float>", "codes": "array<int>", "decoded": "array<float>", **dict(kernel.kept)}
    kind = blocks.schema["block_id"].dataType.simpleString()
    return _with_top(blocks, kernel).mapInArrow(run, f"block_id {kind}, " + ", ".join(f"{n} {types[n]}" for n in names[1:]))


def encode(blocks: DataFrame, codec: str) -> DataFrame:
    """(block_id, scale columns, codes), as CODECS[codec].encode gives them."""
    return _run(blocks, codec, True, False)


def roundtrip(blocks: DataFrame, codec: str) -> DataFrame:
    """(block_id, vals, decoded)."""
    return _run(blocks, codec, False, True)


def decode(coded: DataFrame, codec: str) -> DataFrame:
    """(block_id, vals) of (block_id, scale columns, codes)."""
    kernel = KERNELS[codec]
    names = [n for n, _ in kernel.kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, own = filled(batch.column(1), kernel.size, np.int32)
                kept = {n: batch.column(2 + k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(kernel.decoded(kept, code), own)], names=["block_id", "vals"])

    kind = coded.schema["block_id"].dataType.simpleString()
    return coded.select("block_id", "codes", *names).mapInArrow(run, f"block_id {kind}, vals array<float>")
