"""Python data sources: flat binary arrays, NPY arrays and compressed files.

Formats tidegrid_raw, tidegrid_npy (rows t, samples) and tidegrid_cbin (rows of the chunk table). Files are read
by byte range, a task for some rows; nothing is read on the driver but sizes and headers.
"""

from __future__ import annotations

import ast
import io
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidegrid.functions.dtypes import sample_type
from tidegrid.operators.codec import CHUNK_SCHEMA, numpy_to_lists
from tidegrid.sources import files

PARTITION_BYTES = 64 << 20


@dataclass(frozen=True)
class Layout:
    """Where the samples of a file are."""

    n_rows: int
    n_channels: int
    dtype: str
    offset: int
    fortran: bool = False
    shape: tuple[int, ...] = ()


def raw_layout(path: str, dtype: str, n_channels: int = 1, offset: int = 0) -> Layout:
    """Layout of a flat binary file of rows of n_channels samples behind ``offset`` bytes."""
    if dtype is None:
        raise ValueError("the data type of a flat binary file must be given")
    if n_channels < 1:
        raise ValueError("a signal has at least one channel")
    row = np.dtype(dtype).itemsize * n_channels
    left = files.size(path) - offset
    if left < 0 or left % row:
        raise ValueError(f"{path} has {left} bytes of data, which is not a multiple of {row}, the size of a row of {n_channels} channels of {dtype}")
    return Layout(left // row, n_channels, np.dtype(dtype).str, offset, shape=(left // row, n_channels))


def npy_layout(path: str) -> Layout:
    """Layout of an NPY file; more than two dimensions are flattened to the last one."""
    head = io.BytesIO(files.read_range(path, 0, min(files.size(path), 1 << 16)))
    version = np.lib.format.read_magic(head)
    if version > (2, 0):  # its header differs from 2.0 only in the encoding of field names, which samples don't have
        n = int.from_bytes(head.read(4), "little")
        own = ast.literal_eval(head.read(n).decode("utf-8"))
        shape, fortran, dtype = own["shape"], own["fortran_order"], np.dtype(own["descr"])
    else:
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if len(shape) < 2:
        raise ValueError("a signal has two dimensions, time and channel")
    n_rows = int(np.prod(shape[:-1]))
    return Layout(n_rows, shape[-1], dtype.str, head.tell(), fortran and len(shape) == 2, tuple(shape)) if not (fortran and len(shape) > 2) else _refuse(path)


def _refuse(path: str):
    raise ValueError(f"{path}: arrays in Fortran order of more than two dimensions are not supported")


def read_rows(path: str, at: Layout, first: int, last: int) -> np.ndarray:
    """Rows first..last of a file, in native byte order."""
    kind = np.dtype(at.dtype)
    if at.fortran:
        columns = [np.frombuffer(files.read_range(path, at.offset + (c * at.n_rows + first) * kind.itemsize, (last - first) * kind.itemsize), kind) for c in range(at.n_channels)]
        rows = np.stack(columns, axis=1)
    else:
        row = kind.itemsize * at.n_channels
        rows = np.frombuffer(files.read_range(path, at.offset + first * row, (last - first) * row), kind).reshape(-1, at.n_channels)
    return rows.astype(kind.newbyteorder("="))


@dataclass
class Span(InputPartition):
    first: int
    last: int


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, at: Layout, per: int | None):
        self.path, self.at = path, at
        row = np.dtype(at.dtype).itemsize * at.n_channels
        self.per = per or max(1, PARTITION_BYTES // row)

    def partitions(self):
        return [Span(a, min(a + self.per, self.at.n_rows)) for a in range(0, self.at.n_rows, self.per)] or [Span(0, 0)]

    def read(self, span):
        kind, step = sample_type(self.at.dtype), max(1, 1_000_000 // self.at.n_channels)
        for a in range(span.first, span.last, step):
            b = min(a + step, span.last)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), numpy_to_lists(read_rows(self.path, self.at, a, b), kind)], names=["t", "samples"])


class _ArraySource(DataSource):
    def layout(self) -> Layout:
        raise NotImplementedError

    def schema(self):
        return T.StructType([T.StructField("t", T.LongType()), T.StructField("samples", T.ArrayType(sample_type(self.layout().dtype).spark))])

    def reader(self, schema):
        per = self.options.get("rows_per_partition")
        return ArrayReader(self.options["path"], self.layout(), int(per) if per else None)


class RawSource(_ArraySource):
    """Options path, dtype, n_channels (1), offset (0), rows_per_partition."""

    @classmethod
    def name(cls):
        return "tidegrid_raw"

    def layout(self):
        return raw_layout(self.options["path"], self.options.get("dtype"), int(self.options.get("n_channels", 1)), int(self.options.get("offset", 0)))


class NpySource(_ArraySource):
    """Options path, rows_per_partition; type and shape come from the file."""

    @classmethod
    def name(cls):
        return "tidegrid_npy"

    def layout(self):
        return npy_layout(self.options["path"])


@dataclass
class Chunks(InputPartition):
    ids: tuple[int, ...]


class CompressedReader(DataSourceReader):
    def __init__(self, path: str, header: str | bytes):
        self.path, self.meta = path, json.loads(header)
        self.wanted = range(len(self.meta["chunk_bounds"]) - 1)

    def pushFilters(self, filters):
        """Chunks that filters on chunk_idx, t0 and t1 exclude are not read; Spark evaluates the filters again."""
        bounds = self.meta["chunk_bounds"]
        value = {"chunk_idx": lambda i: i, "t0": lambda i: bounds[i], "t1": lambda i: bounds[i + 1]}
        tests = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if type(f) in tests and column in value:
                test, get = tests[type(f)], value[column]
                self.wanted = [i for i in self.wanted if test(get(i), f.value)]
            yield f

    def partitions(self):
        offsets, out, size = self.meta["chunk_offsets"], [[]], 0
        for i in self.wanted:
            if out[-1] and size + offsets[i + 1] - offsets[i] > PARTITION_BYTES // 8:
                out.append([])
                size = 0
            out[-1].append(i)
            size += offsets[i + 1] - offsets[i]
        return [Chunks(tuple(x)) for x in out]

    def read(self, part):
        offsets, bounds = self.meta["chunk_offsets"], self.meta["chunk_bounds"]
        for i in part.ids:
            payload = files.read_range(self.path, offsets[i], offsets[i + 1] - offsets[i])
            if len(payload) != offsets[i + 1] - offsets[i]:
                raise OSError(f"{self.path} ends within chunk {i}")
            yield (i, bounds[i], bounds[i + 1], len(payload), None, None, payload)  # the format has no digests of chunks


class CompressedSource(DataSource):
    """Options path and header (by default the same name with the suffix .ch), or header_json in place of a file."""

    @classmethod
    def name(cls):
        return "tidegrid_cbin"

    def schema(self):
        return CHUNK_SCHEMA

    def reader(self, schema):
        header = self.options.get("header_json") or files.read_all(self.options.get("header") or default_header(self.options["path"]))
        return CompressedReader(self.options["path"], header)


def default_header(path: str) -> str:
    return files.with_suffix(path, ".ch")


def register(spark: SparkSession) -> None:
    """Make the three formats known to a session, and let filters reach them."""
    for source in (RawSource, NpySource, CompressedSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load_raw(spark: SparkSession, path: str, dtype: str, n_channels: int = 1, offset: int = 0):
    """(t, samples) of a flat binary file, lazily."""
    register(spark)
    raw_layout(path, dtype, n_channels, offset)
    return spark.read.format("tidegrid_raw").options(path=path, dtype=str(np.dtype(dtype).str), n_channels=n_channels, offset=offset).load()


def load_npy(spark: SparkSession, path: str):
    """(t, samples) of an NPY file, lazily."""
    register(spark)
    sample_type(npy_layout(path).dtype)
    return spark.read.format("tidegrid_npy").options(path=path).load()
