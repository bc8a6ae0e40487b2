"""Tables and files in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, never by localCheckpoint: an executor
that is lost takes nothing with it. Where that setting is absent (tests, a local session) a folder is
made for the session and the setting is filled in.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder that ``spark.checkpoint.dir`` names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder; it goes when the session ends."""
    uri = f"{shared_root(spark)}/tidegrid-{label}-{uuid.uuid4().hex}"
    fs, path = _fs(spark, uri)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return uri


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder below the shared folder."""
    fs, path = _fs(spark, uri)
    fs.delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are over: it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    uri = new_dir(spark, label) + "/t"
    write = df.write.option("compression", "zstd")
    if partition_by:
        write = write.partitionBy(*partition_by)
    write.parquet(uri)
    settle(spark)
    out = spark.read.schema(df.schema).parquet(uri)
    out._tidegrid_uri = uri  # for release()
    return out


def release(df: DataFrame) -> None:
    """Drop a table that materialise() wrote and that nothing reads any more."""
    remove(df.sparkSession, df._tidegrid_uri)


@contextmanager
def one_by_one(spark: SparkSession):
    """Large rows reach Python one by one meanwhile: a batch of them would fill a worker's memory, and its executor's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Caches of this process by operator. A Python worker serves one step after another, and its executor pays for all of them.
_caches: dict[str, tuple[dict, ...]] = {}


def register_caches(owner: str, *caches: dict) -> str:
    """Make ``caches`` known to drop_caches() by the name ``owner``."""
    _caches[owner] = caches
    return owner


def drop_caches(*keep: str) -> None:
    """Empty the caches of all operators but ``keep`` in this process, and give free memory back to the system."""
    gone = [c for owner, own in _caches.items() if owner not in keep for c in own if c]
    for c in gone:
        c.clear()
    if gone:
        gc.collect()  # an encoder refers to itself
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory
        trim(0)


#: Bits of a filter: 4 MB whatever the corpus; a larger one only lets more pass.
FILTER_BITS = 1 << 25


def bit_table(df: DataFrame, column: str, size: int = FILTER_BITS) -> np.ndarray:
    """A filter of the values of a bigint column, as bytes: a value that hits() denies is not in it.

    Words of 64 bits are made by the tasks; at most size / 64 of them (some 6 MB of FILTER_BITS) reach the driver.
    """
    place = F.pmod(F.xxhash64(column), F.lit(size))
    words = df.select(place.alias("p")).select(F.expr("cast(p div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 64, "i8")
    for b in words.toArrow().to_batches():
        out[b.column("word").to_numpy()] = b.column("bits").to_numpy()
    return out.view("u1")


def hits(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True for each value (bigint) that a bit_table() may hold."""
    place = xxh64_of_longs(values) & np.uint64(8 * len(table) - 1)
    return (table[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1")) & 1 == 1


def xxh64_of_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a bigint column (XXH64 of its eight bytes), as unsigned integers."""
    u = np.uint64
    p1, p2, p3, p4, p5 = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of XXH64
    turn = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    with np.errstate(over="ignore"):
        h = u(seed) + p5 + u(8)
        h = h ^ (turn(values.astype("i8").view("u8") * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))
