"""Scalar conversions between float32 and small formats, as Spark columns.

Spark widens float32 quotients to double, so every quotient is cast back, which rounds it as float32 division does. Exponents
come from exact powers of two, never from a rounded logarithm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen NF4 levels.
NF4_LEVELS = (
    -1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0,
    0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0,
)
#: The eight E2M1 magnitudes.
E2M1_LEVELS = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
E4M3_MAX, E2M1_MAX = 448.0, 6.0


def f32(x: Column | float) -> Column:
    return (F.lit(float(x)) if isinstance(x, (int, float)) else x).cast("float")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once. Lambdas have no common subexpressions, and the optimizer moves a column that a
    lambda mentions once into it, to be worked out for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def div(a: Column | float, b: Column | float) -> Column:
    """Correctly rounded float32 quotient; division by zero is not an error here but infinite or NaN, as in IEEE."""

    def quotient(r: Column) -> Column:
        zero = F.when(F.isnan(r["a"]) | (r["a"] == 0), F.lit(float("nan"))).otherwise(F.signum(r["a"]) * F.lit(float("inf")))
        return F.when(r["b"] == 0, zero).otherwise(F.try_divide(r["a"], r["b"])).cast("float")

    return let(F.struct(f32(a).cast("double").alias("a"), f32(b).cast("double").alias("b")), quotient)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def sanitize(x: Column) -> Column:
    """Non-finite values become 0."""
    return F.when(is_finite(x), x).otherwise(f32(0))


def negative(x: Column) -> Column:
    """The sign bit of a number that is not NaN: also true for -0.0."""
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def e4m3_encode(x: Column) -> Column:
    """Code 0..255: 4 exponent bits, 3 mantissa bits, bias 7. Beyond 448 and infinite: the largest; NaN: the largest positive.
    Below 2^-6 the mantissa saturates at 7 and does not carry."""

    def magnitude(a: Column) -> Column:
        code = F.when(a < 2.0**-6, F.least(F.rint(a * 512.0), F.lit(7.0)))
        for k in range(-6, 9):
            step = F.lit((k + 7) * 8.0) + F.rint((a * F.lit(2.0**-k) - 1.0) * 8.0)
            code = code.when(a < 2.0 ** (k + 1), step) if k < 8 else code.otherwise(step)
        return code

    def whole(v: Column) -> Column:
        sign = F.when(F.isnan(v), F.lit(0)).when(negative(v), F.lit(128)).otherwise(F.lit(0))
        a = F.when(is_finite(v), F.least(F.abs(v), f32(E4M3_MAX))).otherwise(f32(E4M3_MAX)).cast("double")
        return (let(a, magnitude) + sign).cast("int")

    return let(x, whole)


def e4m3_decode(code: Column) -> Column:
    def value(c: Column) -> Column:
        field, m = F.shiftright(c, 3).bitwiseAND(F.lit(15)), c.bitwiseAND(F.lit(7)).cast("double") / 8.0
        size = F.when(field == 0, m * F.lit(2.0**-6)).otherwise((m + 1.0) * F.pow(F.lit(2.0), field - 7))
        return (F.when(c >= 128, F.lit(-1.0)).otherwise(1.0) * size).cast("float")

    return let(code, value)


def e2m1_encode(x: Column) -> Column:
    """Code 0..15 of the nearest magnitude, ties to the smaller one; non-finite is +-6 (NaN +6); -0.0 has code 8."""

    def whole(v: Column) -> Column:
        sign = F.when(F.isnan(v), F.lit(0)).when(negative(v), F.lit(8)).otherwise(F.lit(0))
        borders = F.array(*[f32((low + high) / 2) for low, high in zip(E2M1_LEVELS, E2M1_LEVELS[1:], strict=False)])
        a = F.when(is_finite(v), F.abs(v)).otherwise(f32(E2M1_MAX))
        return let(a, lambda m: F.size(F.filter(borders, lambda b: m > b))) + sign

    return let(x, whole)


def e2m1_decode(code: Column) -> Column:
    levels = F.array(*[f32(v) for v in E2M1_LEVELS])
    return let(code, lambda c: F.when(c >= 8, f32(-1)).otherwise(f32(1)) * F.element_at(levels, c.bitwiseAND(F.lit(7)) + 1))


def _last_below(low: np.float32, high: np.float32) -> float:
    """The largest float32 that is not nearer to high than to low, by float32 distances."""
    a, b = np.float32(low), np.float32(high)
    while np.nextafter(a, b) != b:
        mid = np.float32((float(a) + float(b)) / 2)
        if mid in (a, b):
            break
        if abs(mid - np.float32(low)) <= abs(mid - np.float32(high)):
            a = mid
        else:
            b = mid
    return float(a)


#: An NF4 code is the number of these that are below the value: borders between nearest levels, ties to the lower code.
NF4_BORDERS = tuple(_last_below(np.float32(a), np.float32(b)) for a, b in zip(NF4_LEVELS, NF4_LEVELS[1:], strict=False))


def nf4_encode(x: Column) -> Column:
    """Code 0..15 of the nearest level, ties to the lower code; non-finite counts as 0."""
    borders = F.array(*[f32(b) for b in NF4_BORDERS])
    return let(sanitize(x), lambda a: F.size(F.filter(borders, lambda b: a > b)))


def nf4_decode(code: Column) -> Column:
    return F.element_at(F.array(*[f32(v) for v in NF4_LEVELS]), code + 1)


def pack_bits(x: Column, exponent: int, mantissa: int, special: bool = True) -> Column:
    """Bits of a format with that many exponent and mantissa bits, rounded half to even; NaN is the quiet positive one. Without
    special values the largest exponent is one like the others, and what is beyond the largest number becomes that."""
    bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1
    full = F.lit(top * 2**mantissa if special else (top + 1) * 2**mantissa - 1)
    kind = "long" if exponent + mantissa > 30 else "int"

    def rounded(r: Column) -> Column:
        q = F.rint(r["a"] / F.pow(F.lit(2.0), r["e"]) * float(2**mantissa))
        return F.least((r["e"] + bias - 1).cast("long") * 2**mantissa + q.cast("long"), full)

    def placed(r: Column) -> Column:  # the logarithm may be one off next to a power of two
        e = r["e"] + (r["a"] >= F.pow(F.lit(2.0), r["e"] + 1)).cast("int") - (r["a"] < F.pow(F.lit(2.0), r["e"])).cast("int")
        return let(F.struct(r["a"].alias("a"), F.greatest(e, F.lit(1 - bias)).alias("e")), rounded)

    def whole(v: Column) -> Column:
        a = F.abs(v.cast("double"))
        near = F.struct(a.alias("a"), F.when(a > 0, F.floor(F.log2(a)).cast("int")).otherwise(1 - bias).alias("e"))
        bits = F.when(F.isnan(v), F.lit(top * 2**mantissa + 2 ** (mantissa - 1)) if special else full).when(a == float("inf"), full).otherwise(let(near, placed))
        sign = 2 ** (exponent + mantissa) if exponent + mantissa < 63 else -(2**63)
        return (bits + F.when(~F.isnan(v) & negative(v), F.lit(sign).cast("long")).otherwise(F.lit(0).cast("long"))).cast("long")

    return let(x, whole).cast(kind)


def unpack_bits(bits: Column, exponent: int, mantissa: int, special: bool = True) -> Column:
    bias, top = 2 ** (exponent - 1) - 1, 2**exponent - 1

    def value(c: Column) -> Column:
        field = F.shiftright(c, mantissa).bitwiseAND(F.lit(top)).cast("int")
        m = c.bitwiseAND(F.lit(2**mantissa - 1)).cast("double") / float(2**mantissa)
        size = F.when(field == 0, m * F.lit(2.0 ** (1 - bias)))
        if special:
            size = size.when(field == top, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        size = size.otherwise((m + 1.0) * F.pow(F.lit(2.0), field - bias))
        return (F.when(F.shiftright(c, exponent + mantissa).bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(1.0) * size).cast("double" if mantissa > 23 else "float")

    return let(bits, value)


def fp32_to_bits(x: Column) -> Column:
    return pack_bits(x, 8, 23)


def fp32_from_bits(bits: Column) -> Column:
    """Of the 32 bits in a long (or a signed int)."""
    return unpack_bits(bits.cast("long"), 8, 23)


def fp64_to_bits(x: Column) -> Column:
    return pack_bits(x, 11, 52)


def fp64_from_bits(bits: Column) -> Column:
    return unpack_bits(bits.cast("long"), 11, 52)


def fp16_alt_encode(x: Column) -> Column:
    """Half precision whose largest exponent is a number: up to 131008, which NaN and what is beyond also become."""
    return pack_bits(x, 5, 10, special=False)


def fp16_alt_decode(bits: Column) -> Column:
    return unpack_bits(bits, 5, 10, special=False)


def bf16_encode(x: Column) -> Column:
    return pack_bits(x, 8, 7)


def bf16_decode(bits: Column) -> Column:
    return unpack_bits(bits, 8, 7)


def fp16_encode(x: Column) -> Column:
    return pack_bits(x, 5, 10)


def fp16_decode(bits: Column) -> Column:
    return unpack_bits(bits, 5, 10)
