"""Block codecs over block tables (block_id, vals): encode adds scales and codes, decode turns them back into floats.

Inside a block everything is array expressions, so encoding moves no rows; tensor-wide scales are one-row aggregates that
are joined back as a single broadcast row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepress.functions import floats as fl


def absmax(vals: str | Column) -> Column:
    """Largest finite magnitude of an array; non-finite values count as 0."""
    return F.array_max(F.transform(vals, lambda v: F.abs(fl.sanitize(v))))


def _tensor(blocks: DataFrame, expression: Column, name: str) -> DataFrame:
    """Adds a tensor-wide aggregate to every block: partial and final aggregate, then one broadcast row."""
    return blocks.crossJoin(F.broadcast(blocks.agg(expression.alias(name))))


@dataclass(frozen=True)
class Codec:
    """scales: block table -> the same with scale columns. scaled: (value, factors) -> what `code` takes; factors are the
    columns `by`, worked out once per block. factor: the column decoded levels are multiplied by; kept: the columns stored."""

    name: str
    size: int
    scales: Callable[[DataFrame], DataFrame]
    by: tuple[str, ...]
    scaled: Callable[[Column, Column], Column]
    code: Callable[[Column], Column]
    level: Callable[[Column], Column]
    factor: Callable[[], Column] | None = None
    kept: tuple[str, ...] = ()

    def _codes(self) -> Column:
        def of(r: Column) -> Column:
            return F.transform("vals", lambda v: fl.let(self.scaled(v, r), self.code))

        return fl.let(F.struct(*self.by), of) if self.by else of(F.lit(0))

    def _values(self) -> Column:
        if self.factor is None:
            return F.transform("codes", self.level)
        return fl.let(self.factor(), lambda f: F.transform("codes", lambda c: f * self.level(c)))

    def encode(self, blocks: DataFrame) -> DataFrame:
        """(block_id, scale columns, codes)."""
        return self.scales(blocks).select("block_id", *self.kept, self._codes().alias("codes"))

    def decode(self, coded: DataFrame) -> DataFrame:
        """(block_id, vals)."""
        return coded.select("block_id", self._values().alias("vals"))

    def roundtrip(self, blocks: DataFrame) -> DataFrame:
        """(block_id, vals, decoded)."""
        coded = self.scales(blocks).withColumn("codes", self._codes())
        return coded.select("block_id", "vals", self._values().alias("decoded"))


def _integer(name: str, top: int) -> Codec:
    def scales(blocks: DataFrame) -> DataFrame:
        scaled = blocks.withColumn("scale", fl.div(absmax("vals"), top))
        return scaled.withColumn("inv", F.when(F.col("scale") == 0, fl.f32(0)).otherwise(fl.div(1.0, F.col("scale"))))

    def code(x: Column) -> Column:
        return F.greatest(F.least(F.rint(fl.sanitize(x)), F.lit(float(top))), F.lit(float(-top))).cast("int")

    return Codec(name, 32, scales, ("inv",), lambda v, r: v * r["inv"], code, lambda c: c.cast("float"), lambda: F.col("scale"), ("scale",))


def _tensor_float(name: str, most: float, encode, decode) -> Codec:
    def scales(blocks: DataFrame) -> DataFrame:
        found = _tensor(blocks, F.max(absmax("vals")), "top")
        found = found.withColumn("scale", F.when(F.coalesce("top", F.lit(0.0)) == 0, fl.f32(1)).otherwise(fl.div(F.col("top"), most)))
        return found.withColumn("inv", fl.div(1.0, F.col("scale")))

    return Codec(name, 256, scales, ("inv",), lambda v, r: v * r["inv"], encode, decode, lambda: F.col("scale"), ("scale",))


def _micro(name: str, most: float, encode, decode) -> Codec:
    def scales(blocks: DataFrame) -> DataFrame:
        target = fl.div(absmax("vals"), most)
        power = F.when(target > 0, F.ceil(F.log2(target).cast("float")).cast("int")).otherwise(0)
        power = F.pmod(power + 128, F.lit(256)) - 128  # as an 8-bit integer
        return blocks.withColumn("exponent", power).withColumn("inv", F.pow(F.lit(2.0), -F.col("exponent")).cast("float"))

    # a power of two within float32: dividing by it and multiplying by its inverse are the same
    return Codec(name, 32, scales, ("inv",), lambda v, r: v * r["inv"], encode, decode, lambda: F.pow(F.lit(2.0), F.col("exponent")).cast("float"), ("exponent",))


def _nvfp4() -> Codec:
    def scales(blocks: DataFrame) -> DataFrame:
        found = _tensor(blocks, F.max(absmax("vals")), "top")
        found = found.withColumn("tensor_scale", F.when(F.coalesce("top", F.lit(0.0)) == 0, fl.f32(1)).otherwise(fl.div(F.col("top"), fl.E2M1_MAX)))
        near = fl.let(F.col("tensor_scale"), lambda t: F.array_max(F.transform("vals", lambda v: fl.let(fl.div(v, t), lambda x: F.abs(fl.sanitize(x))))))
        found = found.withColumn("target", fl.div(near, fl.E2M1_MAX))
        target = F.col("target")
        found = found.withColumn("scale_code", fl.e4m3_encode(F.when(target > 0, target).otherwise(fl.f32(1))))
        found = found.withColumn("inv_tensor", fl.div(1.0, F.col("tensor_scale")))
        return found.withColumn("inv_block", fl.div(1.0, fl.e4m3_decode(F.col("scale_code"))))

    def factor() -> Column:
        return F.col("tensor_scale") * fl.e4m3_decode(F.col("scale_code"))

    return Codec("nvfp4", 16, scales, ("inv_tensor", "inv_block"), lambda v, r: v * r["inv_tensor"] * r["inv_block"], fl.e2m1_encode, fl.e2m1_decode, factor, ("tensor_scale", "scale_code"))


def _nf4() -> Codec:
    def scales(blocks: DataFrame) -> DataFrame:
        top = absmax("vals")
        return blocks.withColumn("scale", F.when(top > 0, top).otherwise(fl.f32(1))).withColumn("inv", fl.div(1.0, F.col("scale")))

    return Codec("nf4", 64, scales, ("inv",), lambda v, r: v * r["inv"], fl.nf4_encode, fl.nf4_decode, lambda: F.col("scale"), ("scale",))


def _block_scale() -> Column:
    found = F.col("dq_scale") * fl.e4m3_decode(F.col("scale_code"))
    return F.when((found == 0) | ~fl.is_finite(found), fl.f32(1)).otherwise(found)


def _nf4_dq() -> Codec:
    def scales(blocks: DataFrame) -> DataFrame:
        top = absmax("vals")
        found = blocks.withColumn("absmax", F.when(top > 0, top).otherwise(fl.f32(1)))
        found = _tensor(found, F.max("absmax"), "top").withColumn("dq_scale", fl.div(F.col("top"), fl.E4M3_MAX))
        found = found.withColumn("dq_scale", F.when(F.col("dq_scale") == 0, fl.f32(1)).otherwise(F.col("dq_scale")))
        found = found.withColumn("scale_code", fl.e4m3_encode(fl.div(F.col("absmax"), F.col("dq_scale"))))
        return found.withColumn("inv", fl.div(1.0, _block_scale()))

    return Codec("nf4_dq", 64, scales, ("inv",), lambda v, r: v * r["inv"], fl.nf4_encode, fl.nf4_decode, _block_scale, ("dq_scale", "scale_code"))


def _plain(name: str, encode, decode) -> Codec:
    return Codec(name, 256, lambda blocks: blocks, (), lambda v, r: v, encode, decode)


CODECS = {
    c.name: c
    for c in (
        _integer("q8_0", 127),
        _integer("q4_0", 7),
        _plain("bf16", fl.bf16_encode, fl.bf16_decode),
        _plain("fp16", fl.fp16_encode, fl.fp16_decode),
        _tensor_float("fp8", fl.E4M3_MAX, fl.e4m3_encode, fl.e4m3_decode),
        _tensor_float("fp4", fl.E2M1_MAX, fl.e2m1_encode, fl.e2m1_decode),
        _micro("mxfp8", fl.E4M3_MAX, fl.e4m3_encode, fl.e4m3_decode),
        _micro("mxfp4", fl.E2M1_MAX, fl.e2m1_encode, fl.e2m1_decode),
        _nvfp4(),
        _nf4(),
        _nf4_dq(),
    )
}
