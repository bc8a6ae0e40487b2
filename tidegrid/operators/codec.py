"""The chunk codec: differences, byte order and deflate of whole chunks, as Arrow functions.

Spark has no deflate function, so this part is Python; each call gets whole chunks and works in NumPy.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.dtypes import SampleType, sample_type
from tidegrid.plans.chunking import Rows
from tidegrid.plans.config import CodecConfig

CHUNK_SCHEMA = "chunk_idx int, t0 bigint, t1 bigint, byte_length bigint, sha1 string, sha1_raw string, payload binary"
#: Samples times channels of a decoded Arrow batch.
BATCH_VALUES = 2_000_000


class IntegrityError(RuntimeError):
    """Compressed data is damaged or does not equal its source."""


def difference(chunk: np.ndarray, axis: int | None) -> np.ndarray:
    """Differences along an axis in the array's own type (integers wrap); the first entry stays."""
    if axis is None:
        return chunk
    first = chunk.take([0], axis=axis)
    return np.concatenate([first, np.diff(chunk, axis=axis)], axis=axis)


def prefix_sum(chunk: np.ndarray, axis: int | None) -> np.ndarray:
    """The inverse of difference()."""
    return chunk if axis is None else np.cumsum(chunk, axis=axis, dtype=chunk.dtype)


def compress_chunk(chunk: np.ndarray, time_diff: bool, spatial_diff: bool, order: str, level: int) -> bytes:
    own = difference(difference(chunk, 0 if time_diff else None), 1 if spatial_diff else None)
    return zlib.compress(own.tobytes(order), level)


def decompress_chunk(payload: bytes, n_rows: int, n_channels: int, dtype: str, time_diff: bool, spatial_diff: bool, order: str) -> np.ndarray:
    try:
        raw = zlib.decompress(payload)
    except zlib.error as e:
        raise IntegrityError(f"a chunk can't be inflated: {e}") from e
    kind = np.dtype(dtype)
    if len(raw) != n_rows * n_channels * kind.itemsize:
        raise IntegrityError(f"a chunk has {len(raw)} bytes; {n_rows} samples of {n_channels} channels are expected")
    own = np.frombuffer(raw, kind).reshape((n_rows, n_channels), order=order)
    return np.ascontiguousarray(prefix_sum(prefix_sum(own, 1 if spatial_diff else None), 0 if time_diff else None))


def arrow_type(kind: SampleType) -> pa.DataType:
    return {"int8": pa.int8(), "uint8": pa.int16(), "int16": pa.int16(), "uint16": pa.int32(), "int32": pa.int32(), "uint32": pa.int64(), "int64": pa.int64(), "uint64": pa.decimal128(20, 0), "float32": pa.float32(), "float64": pa.float64()}[kind.name]


def lists_to_numpy(column, kind: SampleType) -> np.ndarray:
    """An Arrow column of sample lists of one length as (rows, channels)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, n = column.flatten(), len(column)
    if column.null_count or values.null_count:
        raise ValueError("samples must not be null")
    flat = np.array([int(v) for v in values.to_pylist()], dtype="u8") if kind.name == "uint64" else values.to_numpy(zero_copy_only=False)
    if n and len(flat) % n:
        raise ValueError("all samples must have the same number of channels")
    return flat.astype(kind.numpy).reshape(n, -1)


def numpy_to_lists(rows: np.ndarray, kind: SampleType) -> pa.Array:
    held = arrow_type(kind)
    flat = np.ascontiguousarray(rows).reshape(-1)
    values = pa.array([int(v) for v in flat], held) if kind.name == "uint64" else pa.array(flat).cast(held)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), values)


def encode_frame(signal: DataFrame, dtype: str, n_channels: int, n_samples: int, size: int, config: CodecConfig) -> DataFrame:
    """Chunk table (CHUNK_SCHEMA) of a wide signal. One shuffle, on the chunk; chunks are of bounded size.

    A chunk without all its samples, or with others, is refused; that no chunk is missing is checked where the
    table is written, see SignalStore.save().
    """
    kind = sample_type(dtype)
    order, level, td, sd = config.chunk_order, config.comp_level, config.do_time_diff, config.do_spatial_diff

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        t = table.column("t").to_numpy()
        rows = lists_to_numpy(table.column("samples"), kind)
        if rows.shape[1] != n_channels:
            raise ValueError(f"samples have {rows.shape[1]} channels; {n_channels} are expected")
        first = table.column("chunk_idx")[0].as_py() * size
        last = min(first + size, n_samples)
        if len(t) != last - first or (t != np.arange(first, last)).any():
            raise ValueError(f"samples from {first} to {last - 1} are missing or repeated, or others stand among them")
        payload = compress_chunk(rows, td, sd, order, level)
        return pa.table({"chunk_idx": table.column("chunk_idx").slice(0, 1), "t0": pa.array([t[0]], pa.int64()), "t1": pa.array([t[-1] + 1], pa.int64()), "byte_length": pa.array([len(payload)], pa.int64()), "sha1": [hashlib.sha1(payload).hexdigest()], "sha1_raw": [hashlib.sha1(rows.tobytes("C")).hexdigest()], "payload": pa.array([payload], pa.binary())})

    own = signal.select(F.floor(F.col("t") / size).cast("int").alias("chunk_idx"), "t", "samples")
    return own.groupBy("chunk_idx").applyInArrow(encode, CHUNK_SCHEMA)


def decode_frame(chunks: DataFrame, dtype: str, n_channels: int, config: CodecConfig, rows: Rows | None = None, channels: list[int] | None = None) -> DataFrame:
    """(t, samples) of a chunk table, trimmed to ``rows`` and ``channels`` within the decoder; no shuffle."""
    kind = sample_type(dtype)
    order, td, sd = config.chunk_order, config.do_time_diff, config.do_spatial_diff

    def decode(batches):
        for batch in batches:
            for t0, t1, payload in zip(*(batch.column(c).to_pylist() for c in ("t0", "t1", "payload")), strict=True):
                own = decompress_chunk(payload, t1 - t0, n_channels, dtype, td, sd, order)
                t = np.arange(t0, t1)
                if rows is not None:
                    keep = slice(max(rows.start - t0, 0) if t0 <= rows.start else -(t0 - rows.start) % rows.step, max(rows.stop - t0, 0), rows.step)
                    own, t = own[keep], t[keep]
                if channels is not None:
                    own = own[:, channels]
                step = max(1, BATCH_VALUES // max(1, own.shape[1]))
                for at in range(0, len(t), step):
                    yield pa.RecordBatch.from_arrays([pa.array(t[at : at + step], pa.int64()), numpy_to_lists(own[at : at + step], kind)], names=["t", "samples"])

    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("samples", T.ArrayType(kind.spark))])
    return chunks.select("t0", "t1", "payload").mapInArrow(decode, schema)


def encode_file_frame(spark, read, n_samples: int, dtype: str, size: int, config: CodecConfig) -> DataFrame:
    """Chunk table of a file: a task reads and encodes whole chunks, so there is no shuffle.

    read(first, last) gives samples first..last as (rows, channels); it is called on executors.
    """
    kind = sample_type(dtype)
    order, level, td, sd = config.chunk_order, config.comp_level, config.do_time_diff, config.do_spatial_diff
    n_chunks = -(-n_samples // size)

    def encode(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                a, b = i * size, min((i + 1) * size, n_samples)
                rows = np.ascontiguousarray(read(a, b).astype(kind.numpy, copy=False))
                payload = compress_chunk(rows, td, sd, order, level)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([len(payload)], pa.int64()), pa.array([hashlib.sha1(payload).hexdigest()]), pa.array([hashlib.sha1(rows).hexdigest()]), pa.array([payload], pa.binary())], names=["chunk_idx", "t0", "t1", "byte_length", "sha1", "sha1_raw", "payload"])

    parts = max(1, min(n_chunks, 4 * spark.sparkContext.defaultParallelism, n_chunks))
    return spark.range(0, n_chunks, 1, parts).mapInArrow(encode, CHUNK_SCHEMA)


def damaged_frame(chunks: DataFrame, dtype: str, n_channels: int) -> DataFrame:
    """chunk_idx of the chunks whose payload doesn't have its digest or, if none is stored, can't be inflated to its size."""
    row = n_channels * np.dtype(dtype).itemsize

    def sound(n_rows: int, stored: str | None, payload: bytes) -> bool:
        if stored is not None:
            return hashlib.sha1(payload).hexdigest() == stored
        try:  # deflated data ends with a check sum of what it stands for
            return len(zlib.decompress(payload)) == n_rows * row
        except zlib.error:
            return False

    def test(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, t0, t1, stored, payload in rows if not sound(t1 - t0, stored, payload)], pa.int32())], names=["chunk_idx"])

    return chunks.select("chunk_idx", "t0", "t1", "sha1", "payload").mapInArrow(test, "chunk_idx int")


def differing_frame(chunks: DataFrame, dtype: str, n_channels: int, config: CodecConfig, read) -> DataFrame:
    """(chunk_idx, n_bad) of the chunks with samples that differ from read(t0, t1), which executors call; no shuffle."""
    order, td, sd = config.chunk_order, config.do_time_diff, config.do_spatial_diff

    def test(batches):
        for batch in batches:
            out = []
            for i, t0, t1, payload in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own, other = decompress_chunk(payload, t1 - t0, n_channels, dtype, td, sd, order), read(t0, t1)
                same = np.isclose(own, other, rtol=1e-5, atol=1e-16) if own.dtype.kind == "f" else own == other
                if bad := int((~same.all(axis=1)).sum()):
                    out.append((i, bad))
            if out:
                i, bad = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(bad, pa.int64())], names=["chunk_idx", "n_bad"])

    return chunks.select("chunk_idx", "t0", "t1", "payload").mapInArrow(test, "chunk_idx int, n_bad bigint")


def decode_bytes_frame(chunks: DataFrame, dtype: str, n_channels: int, config: CodecConfig) -> DataFrame:
    """(chunk_idx, payload): each chunk's samples as the bytes of a flat file."""
    order, td, sd = config.chunk_order, config.do_time_diff, config.do_spatial_diff

    def decode(batches):
        for batch in batches:
            for i, t0, t1, payload in zip(*(batch.column(c).to_pylist() for c in ("chunk_idx", "t0", "t1", "payload")), strict=True):
                raw = decompress_chunk(payload, t1 - t0, n_channels, dtype, td, sd, order).tobytes("C")
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([raw], pa.binary())], names=["chunk_idx", "payload"])

    return chunks.select("chunk_idx", "t0", "t1", "payload").mapInArrow(decode, "chunk_idx int, payload binary")
