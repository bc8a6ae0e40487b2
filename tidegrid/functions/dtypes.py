"""Sample types: NumPy names, the Spark types that hold them, and modular arithmetic on columns.

Spark has no unsigned integers, so these are held in the next wider type. Arithmetic wraps as it does in the
sample type itself; it is computed in a type that can't overflow, since ANSI mode would raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SampleType:
    name: str
    spark: T.DataType
    bits: int
    signed: bool
    floating: bool = False

    @property
    def numpy(self) -> np.dtype:
        return np.dtype(self.name)


TYPES = {
    x.name: x
    for x in (
        SampleType("int8", T.ByteType(), 8, True),
        SampleType("uint8", T.ShortType(), 8, False),
        SampleType("int16", T.ShortType(), 16, True),
        SampleType("uint16", T.IntegerType(), 16, False),
        SampleType("int32", T.IntegerType(), 32, True),
        SampleType("uint32", T.LongType(), 32, False),
        SampleType("int64", T.LongType(), 64, True),
        SampleType("uint64", T.DecimalType(20, 0), 64, False),
        SampleType("float32", T.FloatType(), 32, True, True),
        SampleType("float64", T.DoubleType(), 64, True, True),
    )
}


def sample_type(dtype) -> SampleType:
    """The type of a NumPy dtype or its name; byte order is not part of it."""
    name = np.dtype(dtype).newbyteorder("=").name
    if name not in TYPES:
        raise ValueError(f"samples of type {name} are not supported; use one of {', '.join(TYPES)}")
    return TYPES[name]


def wide_type(kind: SampleType) -> str:
    """A type in which a difference, or a prefix sum over a chunk, can't overflow."""
    if kind.floating:
        return "double"
    return "decimal(38,0)" if kind.bits == 64 else "bigint"


def wrap(value: Column, kind: SampleType) -> Column:
    """``value`` (of wide_type) reduced to the range of ``kind`` modulo 2**bits, in its Spark type."""
    if kind.floating:
        return value.cast(kind.spark)
    if kind.bits == 64:
        whole, half = F.lit(str(2**64)).cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)")
        value = value.cast("decimal(38,0)")
        if kind.signed:
            return (F.pmod(value + half, whole) - half).cast("bigint")
        return F.pmod(value, whole).cast("decimal(20,0)")
    if kind.signed:
        return F.shiftright(F.shiftleft(value.cast("bigint"), 64 - kind.bits), 64 - kind.bits).cast(kind.spark)
    return value.cast("bigint").bitwiseAND((1 << kind.bits) - 1).cast(kind.spark)


def to_numpy(rows: list, kind: SampleType) -> np.ndarray:
    """Rows of sample lists as a two-dimensional array of the sample type."""
    return np.array(rows, dtype=object if kind.name == "uint64" else None).astype(kind.numpy)


def quantise(value: Column, peak: Column | float) -> Column:
    """value / peak on the int16 scale of 32766, truncated; a peak of 0 leaves the value unscaled."""
    peak = peak if isinstance(peak, Column) else F.lit(float(peak))
    value = value.cast("double")
    return F.when(peak == 0, value).otherwise(value / F.when(peak == 0, F.lit(1.0)).otherwise(peak) * 32766).cast("smallint")


def dequantise(value: Column, peak: Column | float) -> Column:
    """The inverse of quantise(), to within a step."""
    peak = peak if isinstance(peak, Column) else F.lit(float(peak))
    return value.cast("double") * (F.when(peak == 0, F.lit(32766.0)).otherwise(peak) / 32766)


def close(a: Column, original: Column, rtol: float = 1e-5, atol: float = 1e-16) -> Column:
    """Equality of samples: exact for integers, within tolerance of the original for floating point."""
    return F.abs(a - original) <= F.lit(atol) + F.lit(rtol) * F.abs(original)
