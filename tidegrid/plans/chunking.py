"""Chunk bounds, index expressions, and the predicates that prune chunks."""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_size(chunk_duration: float, sample_rate: float) -> int:
    """Samples of a chunk, rounded half to even."""
    size = int(np.round(chunk_duration * sample_rate))
    if size < 1:
        raise ValueError("a chunk has no samples; choose a longer chunk duration")
    return size


def bounds(n_samples: int, size: int) -> list[int]:
    """First samples of all chunks, and the end."""
    return [*range(0, n_samples, size), n_samples]


def bounds_frame(signal: DataFrame, size: int) -> DataFrame:
    """chunk_idx, t0, t1 (exclusive), n_rows of a signal's chunks; aggregated before the shuffle."""
    return signal.groupBy(F.floor(F.col("t") / size).cast("int").alias("chunk_idx")).agg(F.min("t").alias("t0"), (F.max("t") + 1).alias("t1"), F.count("*").alias("n_rows"))


def chunk_span(n_samples: int, size: int, i0: int, i1: int) -> tuple[int, int]:
    """Numbers of the first and the last chunk of the samples i0 to i1, the last included; samples beyond the signal count as its nearest one."""
    near = [min(max(i, 0), n_samples - 1) // size for i in (i0, max(i0, i1))]
    return near[0], near[1]


@dataclass(frozen=True)
class Rows:
    """Samples start, start + step, ... below stop; one is set if a single sample was asked for."""

    start: int
    stop: int
    step: int = 1
    one: bool = False

    def __len__(self) -> int:
        return len(range(self.start, self.stop, self.step))

    def chunk_predicate(self) -> Column:
        """Chunks that overlap [start, stop): on columns of the chunk table, so scans can prune by them."""
        if self.stop <= self.start:
            return F.lit(False)
        return (F.col("t1") > self.start) & (F.col("t0") < self.stop)

    def predicate(self, t: str = "t") -> Column:
        own = (F.col(t) >= self.start) & (F.col(t) < self.stop)
        return own & ((F.col(t) - self.start) % self.step == 0) if self.step != 1 else own


def rows_of(item, n: int) -> Rows:
    """What an index along time means for a signal of n samples."""
    if isinstance(item, slice):
        step = 1 if item.step is None else operator.index(item.step)
        if step <= 0:
            raise ValueError("the step of a slice must be positive")
        start, stop, _ = slice(item.start, item.stop).indices(n)
        return Rows(start, max(start, stop), step)
    if isinstance(item, (list, np.ndarray)):
        raise NotImplementedError("indexing by a list of samples: join with a DataFrame of them, see SignalStore.take()")
    try:
        i = operator.index(item)
    except TypeError:
        raise TypeError(f"a signal can't be indexed by {type(item).__name__}") from None
    if i < 0:
        i %= n
    if i >= n:
        raise IndexError(f"sample {i} is out of range; there are {n}")
    return Rows(i, i + 1, one=True)


def channels_of(item, n: int) -> tuple[list[int], bool]:
    """Channel numbers that an index across channels selects, and whether it is a single one."""
    own = np.arange(n)[item if not isinstance(item, list) else np.array(item, dtype="i8")]
    return np.atleast_1d(own).tolist(), np.ndim(own) == 0
