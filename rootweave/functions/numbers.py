"""Number functions: ranges, index arithmetic, colour and type conversion, 2 x 2 eigenvalues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value range of the integer pixel types.
RANGE = {"uint8": (0, 255), "uint16": (0, 65535), "int16": (-32768, 32767)}


def clip(v: Column, low: float, high: float, scale: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high)) * F.lit(scale)


def linear_map(v: Column, v_min: Column, v_max: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """From [v_min, v_max] to [low, high]; a constant maps to ``low``."""
    span = v_max - v_min
    return F.when(span == 0, F.lit(low)).otherwise(F.lit(low) + (v - v_min) * F.lit(high - low) / span)


def ravel(y: Column, x: Column, width: Column | int) -> Column:
    return y * width + x


def unravel(index: Column, width: int) -> Column:
    return F.struct(F.floor(index / width).cast("long").alias("y"), F.pmod(index, F.lit(width)).alias("x"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.3 * r + 0.59 * g + 0.11 * b


def to_pixel(v: Column, kind: str, overflow: str = "clip", scale: float = 1.0) -> Column:
    """Round to an integer pixel type, values outside clipped or wrapped around."""
    low, high = RANGE[kind]
    out = F.round(v * scale)
    if overflow == "wrap":
        return (F.pmod(out - low, F.lit(high - low + 1)) + low).cast("int")
    return F.least(F.greatest(out, F.lit(low)), F.lit(high)).cast("int")


def from_pixel(v: Column, kind: str) -> Column:
    low, high = RANGE[kind]
    return (v - low) / float(high - low)


def eigenvalues(a: Column, b: Column, c: Column) -> Column:
    """Eigenvalues of [[a, b], [b, c]], the larger by absolute value last."""
    mean, gap = (a + c) / 2, F.sqrt(((a - c) / 2) ** 2 + b * b)
    one, two = mean - gap, mean + gap
    first = F.when(F.abs(one) <= F.abs(two), one).otherwise(two)
    return F.struct(first.alias("l1"), (a + c - first).alias("l2"))


def vesselness(l1: Column, l2: Column, beta: float = 0.5, c: float = 15.0) -> Column:
    """Frangi's measure of dark-on-bright lines from the eigenvalues of a Hessian."""
    blob = (l1 / F.when(l2 == 0, F.lit(1e-12)).otherwise(l2)) ** 2
    strength = l1 * l1 + l2 * l2
    return F.when(l2 < 0, F.lit(0.0)).otherwise(F.exp(-blob / (2 * beta**2)) * (1 - F.exp(-strength / (2 * c**2))))


def gradient_covariance(gy: Column, gx: Column) -> Column:
    """``struct(a, b, c)`` of the symmetric matrix of a gradient's products."""
    return F.struct((gy * gy).alias("a"), (gy * gx).alias("b"), (gx * gx).alias("c"))


def ridge(l1: Column, l2: Column, least: float = 0.0) -> Column:
    """Whether a Hessian's eigenvalues make a dark line: strongly bent across, not along."""
    return (l2 > least) & (F.abs(l1) < F.abs(l2) / 2)


def as_whole(v: Column) -> Column:
    """A whole number, or null where the value is none."""
    d = v.try_cast("double")
    return F.when(d == F.floor(d), d.cast("bigint"))


def is_whole(v: Column) -> Column:
    return F.coalesce(as_whole(v).isNotNull(), F.lit(False))


def is_number(v: Column) -> Column:
    return v.try_cast("double").isNotNull()
