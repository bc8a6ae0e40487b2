"""Differences and prefix sums along time and across channels, as window and array expressions.

Long form is (t, channel, value), wide form (t, samples). Both restart in each chunk of chunk_size samples,
which is part of every window's partition: chunks are independent tasks and can be pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.dtypes import SampleType, wide_type, wrap


def chunk_of(t: str | Column, chunk_size: int) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / F.lit(chunk_size)).cast("int")


def to_long(wide: DataFrame) -> DataFrame:
    """(t, channel, value) of a wide signal."""
    return wide.select("t", F.posexplode("samples").alias("channel", "value"))


def to_wide(long: DataFrame) -> DataFrame:
    """(t, samples) of a long signal."""
    return long.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("samples"))


def _minus(a: Column, b: Column, kind: SampleType) -> Column:
    wide = wide_type(kind)
    return wrap(a.cast(wide) - b.cast(wide), kind)


def time_diff(long: DataFrame, kind: SampleType, chunk_size: int, value: str = "value") -> DataFrame:
    """Each value less the one before it in its channel and chunk; the first stays."""
    over = Window.partitionBy(chunk_of("t", chunk_size), "channel").orderBy("t")
    before = F.lag(value).over(over)
    return long.withColumn(value, F.when(before.isNull(), F.col(value)).otherwise(_minus(F.col(value), before, kind)))


def spatial_diff(long: DataFrame, kind: SampleType, value: str = "value") -> DataFrame:
    """Each value less that of the channel before it at the same time; channel 0 stays."""
    before = F.lag(value).over(Window.partitionBy("t").orderBy("channel"))
    return long.withColumn(value, F.when(before.isNull(), F.col(value)).otherwise(_minus(F.col(value), before, kind)))


def time_cumsum(long: DataFrame, kind: SampleType, chunk_size: int, value: str = "value") -> DataFrame:
    """Inverse of time_diff()."""
    over = Window.partitionBy(chunk_of("t", chunk_size), "channel").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn(value, wrap(F.sum(F.col(value).cast(wide_type(kind).replace("38", "20"))).over(over), kind))


def spatial_cumsum(long: DataFrame, kind: SampleType, value: str = "value") -> DataFrame:
    """Inverse of spatial_diff()."""
    over = Window.partitionBy("t").orderBy("channel").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn(value, wrap(F.sum(F.col(value).cast(wide_type(kind).replace("38", "20"))).over(over), kind))


def wide_time_diff(wide: DataFrame, kind: SampleType, chunk_size: int) -> DataFrame:
    """time_diff() of a wide signal: one lag per row in place of one per value."""
    before = F.lag("samples").over(Window.partitionBy(chunk_of("t", chunk_size)).orderBy("t"))
    change = F.zip_with("samples", before, lambda a, b: _minus(a, b, kind))
    return wide.withColumn("samples", F.when(before.isNull(), F.col("samples")).otherwise(change))


def wide_spatial_diff(wide: DataFrame, kind: SampleType) -> DataFrame:
    """spatial_diff() of a wide signal; no window, no shuffle."""
    one = lambda x, i: F.when(i == 0, x).otherwise(_minus(x, F.get("samples", i - 1), kind))
    return wide.withColumn("samples", F.transform("samples", one))


def wide_spatial_cumsum(wide: DataFrame, kind: SampleType) -> DataFrame:
    """spatial_cumsum() of a wide signal; no window, no shuffle."""
    held = wide_type(kind)
    none = F.struct(F.lit(0).cast(held).alias("total"), F.array().cast(f"array<{held}>").alias("all"))

    def add(a, x):
        total = (a["total"] + x.cast(held.replace("38", "20"))).cast(held)
        return F.struct(total.alias("total"), F.array_append(a["all"], total).alias("all"))

    sums = F.aggregate("samples", none, add, lambda a: a["all"])  # one addition per channel; copies are of plain arrays
    return wide.withColumn("samples", F.transform(sums, lambda x: wrap(x, kind)))
