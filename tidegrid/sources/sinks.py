"""Ordered files: parts that tasks write side by side, joined in order by the commit.

A signal as one flat file and a compressed file are single ordered byte streams, so the parts have to be put one
after another. That is done by copying them in buffers of fixed size, and the digests are taken on the way.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidegrid.functions.dtypes import sample_type, to_numpy
from tidegrid.sources import files

BUFFER = 1 << 22


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    digest: str
    size: int


class OrderedWriter(DataSourceWriter):
    """Rows to bytes, by partition number."""

    def __init__(self, path: str, to_bytes, overwrite: bool, prefix: bytes = b""):
        if files.exists(path) and not overwrite:
            raise FileExistsError(f"{path} exists")
        self.path, self.to_bytes, self.run, self.prefix = path, to_bytes, uuid.uuid4().hex, prefix

    def write(self, rows):
        task = TaskContext.get()
        part = f"{self.path}.{self.run}.{task.partitionId():08d}.{task.taskAttemptId()}"
        system, path = files.locate(part)
        system.create_dir(path.rpartition("/")[0] or ".", recursive=True)
        seen, size = hashlib.sha1(), 0
        with system.open_output_stream(path, compression=None) as f:
            for data in self.to_bytes(rows):
                seen.update(data)
                size += len(data)
                f.write(data)
        return Part(task.partitionId(), part, seen.hexdigest(), size)

    def commit(self, messages):
        system, path = files.locate(self.path)
        whole = hashlib.sha1()
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with system.open_output_stream(path, compression=None) as out:
            whole.update(self.prefix)
            out.write(self.prefix)
            for m in parts:
                source, own = files.locate(m.path)
                with source.open_input_stream(own, compression=None) as f:
                    while data := f.read(BUFFER):
                        whole.update(data)
                        out.write(data)
                source.delete_file(own)
        files.write_all(self.path + ".sha1", whole.hexdigest().encode())

    def abort(self, messages):
        for m in messages:
            if m is not None:
                system, path = files.locate(m.path)
                system.delete_file(path)


class _Samples:
    def __init__(self, dtype: str):
        self.dtype = dtype

    def __call__(self, rows):
        kind, held = sample_type(self.dtype), []
        for r in rows:
            held.append(r["samples"])
            if len(held) >= 4096:
                yield to_numpy(held, kind).tobytes("C")
                held = []
        if held:
            yield to_numpy(held, kind).tobytes("C")


class _Payloads:
    def __call__(self, rows):
        for r in rows:
            yield bytes(r["payload"])


class RawSink(DataSource):
    """Writes (t, samples), in order of t, as a flat binary file. Options path, dtype."""

    @classmethod
    def name(cls):
        return "tidegrid_raw_sink"

    def writer(self, schema, overwrite):
        return OrderedWriter(self.options["path"], _Samples(self.options["dtype"]), overwrite)


class NpySink(DataSource):
    """Writes (t, samples), in order of t, as an NPY file. Options path, dtype, shape (JSON)."""

    @classmethod
    def name(cls):
        return "tidegrid_npy_sink"

    def writer(self, schema, overwrite):
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(self.options["dtype"]).str, "fortran_order": False, "shape": tuple(json.loads(self.options["shape"]))})
        return OrderedWriter(self.options["path"], _Samples(self.options["dtype"]), overwrite, head.getvalue())


class CompressedSink(DataSource):
    """Writes chunk rows, in order of chunk_idx, as one file. Option path."""

    @classmethod
    def name(cls):
        return "tidegrid_cbin_sink"

    def writer(self, schema, overwrite):
        return OrderedWriter(self.options["path"], _Payloads(), overwrite)


def write_ordered(df: DataFrame, by: str, form: str, overwrite: bool, **options) -> str:
    """Write ``df`` in order of ``by``; returns the SHA-1 of the file."""
    spark = df.sparkSession
    if files.exists(options["path"]) and not overwrite:
        raise FileExistsError(f"{options['path']} exists")
    spark.dataSource.register(RawSink)
    spark.dataSource.register(NpySink)
    spark.dataSource.register(CompressedSink)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(n, by).sortWithinPartitions(by)
    ordered.write.format(form).options(**options).mode("overwrite" if overwrite else "append").save()
    digest = files.read_all(options["path"] + ".sha1").decode()
    system, path = files.locate(options["path"] + ".sha1")
    system.delete_file(path)
    return digest
