"""Two-bit codes in super-blocks of 256 with sixteen affine sub-blocks.

The searching variants fit scale and minimum in float32 steps whose outcome feeds the next step. Fits and codes run in NumPy over
Arrow batches, all sub-blocks of a batch at once; decoding is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepress.functions import floats as fl

SUPER, SUB = 256, 16
_F = np.float32


def fast_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A third of the range, and the minimum, of each row of 16."""
    low = np.fmin.reduce(x, 1)
    return np.fmax.reduce(x - low[:, None], 1) / _F(3), low


def search(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale and minimum of each row of 16 by weighted absolute error, over one plain and sixteen least-squares candidates.

    float32 throughout, sums in order. A better candidate's minimum replaces the minimum that later candidates start from.
    """
    x, w = x.astype(_F), w.astype(_F)
    low, high = x.min(1), x.max(1)
    total, first = np.zeros(len(x), _F), np.zeros(len(x), _F)
    for i in range(SUB):
        total, first = (w[:, i], w[:, i] * x[:, i]) if i == 0 else (total + w[:, i], first + w[:, i] * x[:, i])
    low = np.where(low > 0, _F(0), low)
    flat = high == low

    def codes(inverse):
        return np.clip(np.rint(inverse[:, None] * (x - low[:, None])), 0, 3).astype(_F)

    def error(scale, least, code):
        out = np.zeros(len(x), _F)
        for i in range(SUB):
            out = out + w[:, i] * np.abs(scale * code[:, i] + least - x[:, i])
        return out

    with np.errstate(all="ignore"):
        inverse = _F(3) / (high - low)
        scale = _F(1) / inverse
        best = error(scale, low, codes(inverse))
        for step in range(16):
            code = codes((_F(-0.5) + _F(0.1) * _F(step) + _F(3)) / (high - low))
            l1, l2, lx = (np.zeros(len(x), _F) for _ in range(3))
            for i in range(SUB):
                wl = w[:, i] * code[:, i]
                l1, l2, lx = l1 + wl, l2 + wl * code[:, i], lx + wl * x[:, i]
            det = total * l2 - l1 * l1
            new_scale = (total * lx - first * l1) / det
            new_low = (l2 * first - l1 * lx) / det
            new_scale = np.where(new_low > 0, lx / l2, new_scale)
            new_low = np.where(new_low > 0, _F(0), new_low)
            err = error(new_scale, new_low, code)
            better = (det > 0) & (err < best) & ~flat
            best, scale, low = np.where(better, err, best), np.where(better, new_scale, scale), np.where(better, new_low, low)
    return np.where(flat, _F(0), scale).astype(_F), low.astype(_F)


def quantize(x: np.ndarray, scales: np.ndarray, mins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super scale and minimum as half-precision bits, a byte per sub-block (low nibble its scale, high nibble its signed minimum),
    and codes 0..3 against the rounded scale and minimum, of super-blocks of 256 in rows. float32 throughout."""
    n = len(x)
    scales, mins = scales.reshape(n, -1), mins.reshape(n, -1)
    top, top_min = np.fmax.reduce(scales, 1), np.fmax.reduce(np.abs(mins), 1)
    super_scale, super_min = (np.where(t > 0, t / _F(most), _F(0)).astype(np.float16) for t, most in ((top, 15), (top_min, 7)))
    some, some_min = (top > 0)[:, None], (top_min > 0)[:, None]
    low = np.where(some, np.nan_to_num(np.rint((_F(15) / top)[:, None] * scales)), 0).astype(np.int64) & 255
    high = np.where(some_min, np.clip(np.nan_to_num(np.rint((_F(7) / top_min)[:, None] * mins)), -8, 7), 0).astype(np.int64)
    scale_codes = low | ((high & 15) << 4)
    sub_scale = super_scale.astype(_F)[:, None] * (low & 15).astype(_F)
    sub_min = super_min.astype(_F)[:, None] * high.astype(_F)
    parts = x.reshape(n, -1, SUB)
    near = np.rint((parts - sub_min[:, :, None]) / sub_scale[:, :, None])
    codes = np.where(sub_scale[:, :, None] > 0, np.clip(np.nan_to_num(near), 0, 3), 0).astype(np.int32).reshape(n, -1)
    return super_scale.view(np.uint16).astype(np.int32), super_min.view(np.uint16).astype(np.int32), scale_codes.astype(np.int32), codes


def _filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 256, short ones filled with zeros, and the rows' own lengths."""
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(_F)
    out = np.zeros((len(size), SUPER), _F)
    out[np.arange(SUPER)[None] < size[:, None]] = values
    return out, size


def encode(blocks: DataFrame, method: str = "q2_k", weights: str | None = None) -> DataFrame:
    """(block_id, n, super_scale, super_min, scale_codes, codes) of blocks of at most 256 values; short ones are filled with zeros,
    which take part in the fit, and n keeps the true length.

    method: q2_k (magnitudes as weights), q2_k_importance (weights from an array column) or q2_k_fast. Fit and codes of all
    sub-blocks of a batch are worked out at once; no rows move.
    """
    if method == "q2_k_importance" and weights is None:
        raise ValueError("q2_k_importance needs a column of weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, size = _filled(batch.column(1))
            flat = x.reshape(-1, SUB)
            with np.errstate(all="ignore"):
                if method == "q2_k_fast" and weights is None:
                    fitted = fast_fit(flat)
                else:
                    fitted = search(flat, np.abs(flat) if weights is None else _filled(batch.column(2))[0].reshape(-1, SUB))
                super_scale, super_min, scale_codes, codes = quantize(x, *fitted)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel())) for v in (scale_codes, codes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array(super_scale), pa.array(super_min), *lists], names=["block_id", "n", "super_scale", "super_min", "scale_codes", "codes"])

    columns = ["block_id", F.col("vals").cast("array<float>").alias("vals"), *([F.col(weights).cast("array<float>").alias("weights")] if weights else [])]
    kind = blocks.schema["block_id"].dataType.simpleString()
    return blocks.select(*columns).mapInArrow(run, f"block_id {kind}, n int, super_scale int, super_min int, scale_codes array<int>, codes array<int>")


def _with_affine(coded: DataFrame) -> DataFrame:
    def least(factor: Column, c: Column) -> Column:
        m = F.shiftright(c, 4)
        return factor * F.when(m > 7, m - 16).otherwise(m).cast("float")

    scales = fl.let(fl.fp16_decode(F.col("super_scale")), lambda f: F.transform("scale_codes", lambda c: f * c.bitwiseAND(F.lit(15)).cast("float")))
    mins = fl.let(fl.fp16_decode(F.col("super_min")), lambda f: F.transform("scale_codes", lambda c: least(f, c)))
    return coded.withColumn("sub_scales", scales).withColumn("sub_mins", mins)


def decode(coded: DataFrame) -> DataFrame:
    """(block_id, vals), of the true length."""

    def value(r: Column, c: Column, i: Column) -> Column:
        j = F.shiftright(i, 4)
        return F.get(r["sub_mins"], j) + F.get(r["sub_scales"], j) * c.cast("float")

    values = fl.let(F.struct("sub_scales", "sub_mins"), lambda r: F.transform("codes", lambda c, i: value(r, c, i)))
    return _with_affine(coded).select("block_id", F.slice(values, F.lit(1), F.col("n")).alias("vals"))


def pack_codes(codes: Column) -> Column:
    """The 64 data bytes: byte j / 4 + l holds elements j + l, + 32, + 64, + 96, from the low bits up."""
    at = [(j, l) for j in (0, 128) for l in range(32)]  # noqa: E741
    place = F.array(*[F.lit(j + l) for j, l in at])

    def byte(p: Column) -> Column:
        parts = [F.shiftleft(F.get(codes, p + 32 * k), 2 * k) for k in range(4)]
        return F.lpad(F.hex(parts[0] + parts[1] + parts[2] + parts[3]), 2, "0")

    return F.unhex(F.array_join(F.transform(place, byte), ""))
