"""SignalStore: encoded signals with random access.

A store is a chunk table and its metadata. Indexing gives a lazy DataFrame: the range of samples becomes a filter
on the chunk table, which prunes partitions and row groups, and the decoder trims rows and channels, so
nothing else is inflated or leaves a task.
"""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.dtypes import close, sample_type
from tidegrid.operators.codec import CHUNK_SCHEMA, IntegrityError, damaged_frame, decode_bytes_frame, decode_frame, differing_frame, encode_file_frame, encode_frame
from tidegrid.plans import chunking
from tidegrid.plans.chunking import Rows
from tidegrid.plans.config import CodecConfig
from tidegrid.sources import arrays, files, sinks

log = logging.getLogger("tidegrid")
FORMAT_VERSION = "1.0"
#: Chunks of one folder of a stored table.
BUCKET = 1024


@dataclass(frozen=True)
class SignalMeta:
    """Shape, type and codec settings of an encoded signal."""

    dtype: str
    n_channels: int
    n_samples: int
    sample_rate: float
    chunk_size: int
    config: CodecConfig
    shape: tuple[int, ...] = ()
    chopped: bool = False
    sha1_compressed: str | None = None
    sha1_uncompressed: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def chunk_bounds(self) -> list[int]:
        return chunking.bounds(self.n_samples, self.chunk_size)

    @property
    def n_chunks(self) -> int:
        return -(-self.n_samples // self.chunk_size)

    def header(self, chunk_offsets: list[int]) -> dict:
        """The header of a single-file store. Field names are fixed values of the format."""
        out = {
            "algorithm": self.config.algorithm,
            "chunk_bounds": self.chunk_bounds,
            "chunk_offsets": chunk_offsets,
            "chunk_order": self.config.chunk_order,
            "comp_level": self.config.comp_level,
            "do_spatial_diff": self.config.do_spatial_diff,
            "do_time_diff": self.config.do_time_diff,
            "dtype": self.dtype,
            "n_channels": self.n_channels,
            "sample_rate": self.sample_rate,
            "sha1_compressed": self.sha1_compressed,
            "sha1_uncompressed": self.sha1_uncompressed,
            "shape": list(self.shape or (self.n_samples, self.n_channels)),
            "version": FORMAT_VERSION,
        }
        return out | ({"chopped": True} if self.chopped else {})

    @classmethod
    def from_header(cls, h: dict) -> SignalMeta:
        bounds = h["chunk_bounds"]
        size = bounds[1] - bounds[0] if len(bounds) > 1 else 1
        config = CodecConfig(algorithm=h.get("algorithm", "zlib"), chunk_order=h.get("chunk_order", "F"), comp_level=h.get("comp_level", -1), do_time_diff=h["do_time_diff"], do_spatial_diff=h["do_spatial_diff"], chunk_duration=size / h["sample_rate"])
        return cls(h["dtype"], h["n_channels"], bounds[-1], float(h["sample_rate"]), size, config, tuple(h.get("shape") or ()), bool(h.get("chopped")), h.get("sha1_compressed"), h.get("sha1_uncompressed"))


class SignalStore:
    def __init__(self, chunks: DataFrame, meta: SignalMeta):
        self.chunks, self.meta, self.spark = chunks, meta, chunks.sparkSession

    # writing

    @classmethod
    def encode(cls, signal: DataFrame, dtype: str, sample_rate: float, n_samples: int | None = None, n_channels: int | None = None, shape: tuple[int, ...] = (), **settings) -> SignalStore:
        """Encode a wide signal (t from 0, samples). n_samples and n_channels are looked up if not given."""
        config = CodecConfig.resolve(**settings)
        kind = sample_type(dtype)
        if n_samples is None or n_channels is None:
            found = signal.agg(F.max("t").alias("last"), F.max(F.size("samples")).alias("channels")).first()
            n_samples, n_channels = n_samples or (0 if found["last"] is None else found["last"] + 1), n_channels or found["channels"] or 0
        if n_samples == 0 or n_channels == 0:
            raise ValueError("a signal without samples or channels can't be encoded")
        if kind.floating and config.do_time_diff:
            log.warning("differences of floating-point samples are not exact; turn do_time_diff off for an exact copy")
        size = chunking.chunk_size(config.chunk_duration, sample_rate)
        chunks = encode_frame(signal, kind.name, n_channels, n_samples, size, config)
        return cls(chunks, SignalMeta(kind.name, n_channels, n_samples, float(sample_rate), size, config, tuple(shape) or (n_samples, n_channels)))

    @classmethod
    def from_raw(cls, spark: SparkSession, path: str, sample_rate: float | None = None, n_channels: int | None = None, dtype: str | None = None, offset: int = 0, **settings) -> SignalStore:
        """Encode a flat binary file; what isn't given comes from the settings."""
        config = CodecConfig.resolve(sample_rate=sample_rate, n_channels=n_channels, dtype=dtype, **settings)
        missing = [k for k in ("sample_rate", "n_channels", "dtype") if getattr(config, k) is None]
        if missing:
            raise ValueError(f"{', '.join(missing)} must be given for a flat binary file")
        at = arrays.raw_layout(path, config.dtype, config.n_channels, offset)
        return cls._encode_file(spark, path, at, config)

    @classmethod
    def _encode_file(cls, spark: SparkSession, path: str, at: arrays.Layout, config: CodecConfig) -> SignalStore:
        if at.n_rows == 0 or at.n_channels == 0:
            raise ValueError("a signal without samples or channels can't be encoded")
        kind = sample_type(at.dtype)
        size = chunking.chunk_size(config.chunk_duration, config.sample_rate)
        chunks = encode_file_frame(spark, lambda a, b: arrays.read_rows(path, at, a, b), at.n_rows, kind.name, size, config)
        return cls(chunks, SignalMeta(kind.name, at.n_channels, at.n_rows, float(config.sample_rate), size, config, at.shape))

    @classmethod
    def from_npy(cls, spark: SparkSession, path: str, sample_rate: float | None = None, **settings) -> SignalStore:
        """Encode an NPY file; more than two dimensions are flattened to the last, the shape is kept."""
        at, config = arrays.npy_layout(path), CodecConfig.resolve(sample_rate=sample_rate, **settings)
        if config.sample_rate is None:
            raise ValueError("sample_rate must be given")
        return cls._encode_file(spark, path, at, config)

    def save(self, folder: str, mode: str = "errorifexists") -> SignalStore:
        """Write the chunk table as Parquet, in folders of BUCKET chunks, and return the stored one; all chunks must be there."""
        table = self.chunks.withColumn("bucket", F.floor(F.col("chunk_idx") / BUCKET).cast("int"))
        table.write.mode(mode).partitionBy("bucket").parquet(f"{folder}/chunks")
        meta = self.meta.header([]) | {"chunk_bounds": [], "n_samples": self.meta.n_samples, "chunk_size": self.meta.chunk_size}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/meta")
        stored = self.open(self.spark, folder)
        stored._complete(stored.chunks.count())
        return stored

    def _complete(self, n_chunks: int) -> None:
        if n_chunks != self.meta.n_chunks:
            raise IntegrityError(f"the signal has {n_chunks} chunks; {self.meta.n_samples} samples make {self.meta.n_chunks}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SignalStore:
        """A store that save() wrote, from any place that Spark reads."""
        h = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        size, n = h["chunk_size"], h["n_samples"]
        meta = SignalMeta.from_header(h | {"chunk_bounds": [0, size]})
        meta = SignalMeta(meta.dtype, meta.n_channels, n, meta.sample_rate, size, meta.config, meta.shape, meta.chopped, meta.sha1_compressed, meta.sha1_uncompressed)
        return cls(spark.read.schema(CHUNK_SCHEMA + ", bucket int").parquet(f"{folder}/chunks"), meta)

    def write_cbin(self, out: str, outmeta: str | None = None, overwrite: bool = False) -> dict:
        """Write one compressed file and its JSON header; returns ratio, bytes and both digests.

        The digest of the whole uncompressed signal is a fold over all samples in order, in one task; it is taken
        only if results are to be checked, else it is null. The file is put together on the driver from parts
        that the tasks wrote; save() has no such step and is the way to keep large signals.
        """
        outmeta = outmeta or arrays.default_header(out)
        if files.exists(outmeta) and not overwrite:
            raise FileExistsError(f"{outmeta} exists")
        chunks = self.chunks.persist()
        sha = sinks.write_ordered(chunks, "chunk_idx", "tidegrid_cbin_sink", overwrite, path=out)
        lengths = [r[0] for r in chunks.select("byte_length").orderBy("chunk_idx").collect()]  # a number per chunk, as the header holds
        self._complete(len(lengths))
        offsets, checked = np.concatenate([[0], np.cumsum(lengths)]).tolist(), self.meta.config.check_after_compress
        meta = SignalMeta(**{**self.meta.__dict__, "sha1_compressed": sha, "sha1_uncompressed": self.sha1_uncompressed() if checked and not self.meta.chopped else None})
        if self.meta.chopped:
            meta = SignalMeta(**{**meta.__dict__, "sha1_compressed": None})
        files.write_all(outmeta, json.dumps(meta.header(offsets), indent=2, sort_keys=True).encode())
        chunks.unpersist()
        raw = self.meta.n_samples * self.meta.n_channels * np.dtype(self.meta.dtype).itemsize
        if checked and (offsets[-1] != files.size(out) or not SignalStore.open_cbin(self.spark, out, outmeta).damaged().isEmpty()):
            raise IntegrityError(f"{out} does not hold what was written")
        return {"ratio": offsets[-1] / raw, "bytes": offsets[-1], "sha1_compressed": sha, "sha1_uncompressed": meta.sha1_uncompressed}

    @classmethod
    def open_cbin(cls, spark: SparkSession, cdata: str, cmeta: str | dict | None = None, **settings) -> SignalStore:
        """A compressed file; the header is a path, a dict, or by default the sibling .ch file.

        ``settings`` are those of reading: check_after_decompress and cached.
        """
        arrays.register(spark)
        if unknown := settings.keys() - {"check_after_decompress", "cached"}:
            raise ValueError(f"not settings of reading: {', '.join(sorted(unknown))}")
        given = {"header_json": json.dumps(cmeta)} if isinstance(cmeta, dict) else {"header": cmeta or arrays.default_header(cdata)}
        meta = SignalMeta.from_header(cmeta if isinstance(cmeta, dict) else json.loads(files.read_all(given["header"])))
        config = CodecConfig.resolve(**{**settings, **{k: getattr(meta.config, k) for k in ("algorithm", "chunk_order", "comp_level", "do_time_diff", "do_spatial_diff", "chunk_duration")}})
        return cls(spark.read.format("tidegrid_cbin").options(path=cdata, **given).load(), SignalMeta(**{**meta.__dict__, "config": config}))

    # reading

    @property
    def shape(self) -> tuple[int, int]:
        return self.meta.n_samples, self.meta.n_channels

    ndim = 2

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.meta.dtype)

    @property
    def duration(self) -> float:
        return self.meta.n_samples / self.meta.sample_rate

    def _pruned(self, rows: Rows) -> DataFrame:
        out = self.chunks.where(rows.chunk_predicate())
        if rows.stop > rows.start:
            size = self.meta.chunk_size
            first, last = rows.start // size, (rows.stop - 1) // size
            out = out.where(F.col("chunk_idx").between(first, last))
            if "bucket" in self.chunks.columns:
                out = out.where(F.col("bucket").between(first // BUCKET, last // BUCKET))
        return out

    def decode(self, rows: Rows | None = None, channels: list[int] | None = None) -> DataFrame:
        """(t, samples) of some rows and channels, or all."""
        chunks = self.chunks if rows is None else self._pruned(rows)
        out = decode_frame(chunks, self.meta.dtype, self.meta.n_channels, self.meta.config, rows, channels)
        return out.persist() if self.meta.config.cached else out

    def __getitem__(self, item) -> DataFrame:
        """Rows, or (rows, channels), as NumPy would select them: (t, samples), or (t, value) of one channel."""
        across = None
        if isinstance(item, tuple):
            if not 1 <= len(item) <= 2:
                raise TypeError("a signal has two dimensions")
            item, across = item if len(item) == 2 else (item[0], None)
        rows = chunking.rows_of(item, self.meta.n_samples)
        if across is None:
            return self.decode(rows)
        channels, one = chunking.channels_of(across, self.meta.n_channels)
        out = self.decode(rows, channels)
        return out.select("t", F.get("samples", F.lit(0)).alias("value")) if one else out

    def take(self, wanted: DataFrame) -> DataFrame:
        """Samples whose t is in ``wanted``; chunks without any are not decoded."""
        size = self.meta.chunk_size
        ids = wanted.select(F.floor(F.col("t") / size).cast("int").alias("chunk_idx")).distinct()
        chunks = self.chunks.join(ids, "chunk_idx", "left_semi")
        return decode_frame(chunks, self.meta.dtype, self.meta.n_channels, self.meta.config).join(wanted.select("t").distinct(), "t", "left_semi")

    def decode_chunks(self, ids: list[int]) -> DataFrame:
        """(t, samples) of the chunks of these numbers."""
        return decode_frame(self.chunks.where(F.col("chunk_idx").isin(list(ids))), self.meta.dtype, self.meta.n_channels, self.meta.config)

    def get_chunk(self, i: int) -> DataFrame:
        if not 0 <= i < self.meta.n_chunks:
            raise IndexError(f"chunk {i} is out of range; there are {self.meta.n_chunks}")
        return self.decode_chunks([i])

    def index(self) -> DataFrame:
        """chunk_idx, t0, t1, byte_offset, byte_length of all chunks: a few numbers a chunk, without payloads."""
        from pyspark.sql import Window

        before = Window.orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
        return self.chunks.select("chunk_idx", "t0", "t1", F.coalesce(F.sum("byte_length").over(before), F.lit(0)).alias("byte_offset"), "byte_length")

    def iter_chunks(self, first: int = 0, last: int | None = None):
        """(chunk_idx, byte_offset, byte_length) of chunks first..last, the last included."""
        last = self.meta.n_chunks - 1 if last is None else last
        for r in self.index().where(F.col("chunk_idx").between(first, last)).orderBy("chunk_idx").toLocalIterator():
            yield r.chunk_idx, r.byte_offset, r.byte_length

    def tofile(self, out: str, overwrite: bool = False) -> str:
        """All samples as one flat file in order of time; returns its SHA-1."""
        raw = decode_bytes_frame(self.chunks, self.meta.dtype, self.meta.n_channels, self.meta.config)
        sha = sinks.write_ordered(raw, "chunk_idx", "tidegrid_cbin_sink", overwrite, path=out)
        if self.meta.config.check_after_decompress:
            if files.size(out) != self.meta.n_samples * self.meta.n_channels * self.dtype.itemsize:
                raise IntegrityError(f"{out} does not have the size of the signal")
            if self.meta.sha1_uncompressed not in (None, sha) and not self.dtype.kind == "f":
                raise IntegrityError(f"{out} does not have the digest of the signal")
        return sha

    def chop(self, n_chunks: int) -> SignalStore | None:
        """The first n_chunks chunks, undecoded; None if there are no more than these."""
        if n_chunks < 1:
            raise ValueError("at least one chunk must be kept")
        if n_chunks >= self.meta.n_chunks:
            log.warning("there are only %d chunks; nothing to chop", self.meta.n_chunks)
            return None
        kept = self.chunks.where(F.col("chunk_idx") < n_chunks)
        meta = {**self.meta.__dict__, "n_samples": n_chunks * self.meta.chunk_size, "chopped": True, "sha1_compressed": None, "sha1_uncompressed": None}
        return SignalStore(kept, SignalMeta(**meta))

    # facts and checks

    def describe(self) -> DataFrame:
        """One row: dtype, sample_rate, n_channels, duration, n_samples, chunk_duration, n_chunks."""
        own = self.chunks.agg(F.sum(F.col("t1") - F.col("t0")).alias("n_samples"), F.avg(F.col("t1") - F.col("t0")).alias("mean"), F.count("*").alias("n_chunks"))
        rate = F.lit(self.meta.sample_rate)
        seconds = lambda c: F.format_string("%.1fs", c)
        return own.select(F.lit(self.meta.dtype).alias("dtype"), rate.alias("sample_rate"), F.lit(self.meta.n_channels).alias("n_channels"), seconds(F.col("n_samples") / rate).alias("duration"), "n_samples", seconds(F.col("mean") / rate).alias("chunk_duration"), "n_chunks")

    def compression_stats(self) -> DataFrame:
        """One row: raw_bytes, compressed_bytes, ratio."""
        item = np.dtype(self.meta.dtype).itemsize * self.meta.n_channels
        own = self.chunks.agg((F.sum(F.col("t1") - F.col("t0")) * item).alias("raw_bytes"), F.sum("byte_length").alias("compressed_bytes"))
        return own.withColumn("ratio", F.col("compressed_bytes") / F.col("raw_bytes"))

    def violations(self, original: DataFrame) -> DataFrame:
        """t of all samples that are missing on one side or differ: exactly for integers, by tolerance for floats."""
        kind = sample_type(self.meta.dtype)
        both = self.decode().withColumnRenamed("samples", "a").join(original.select("t", F.col("samples").alias("b")), "t", "full_outer")
        if kind.floating:
            same = (F.size("a") == F.size("b")) & F.forall(F.zip_with("a", "b", lambda a, b: F.coalesce(close(a.cast("double"), b.cast("double")), F.lit(False))), lambda x: x)
        else:
            same = F.col("a") == F.col("b")
        return both.where(~F.coalesce(same, F.lit(False))).select("t")

    def verify(self, original: DataFrame, before_check=None) -> None:
        """Raise IntegrityError unless decoding gives the original; before_check(store) is called first."""
        if before_check is not None:
            before_check(self)
        try:
            bad = self.violations(original).count()
        except Exception as e:
            raise IntegrityError(f"the compressed signal can't be read: {str(e)[:300]}") from e
        if bad:
            raise IntegrityError(f"{bad} samples differ from the original")

    def verify_file(self, path: str, at: arrays.Layout) -> None:
        """Raise IntegrityError unless decoding gives the rows of a file; a task reads the rows of its own chunks, so nothing is shuffled."""
        try:
            bad = differing_frame(self.chunks, self.meta.dtype, self.meta.n_channels, self.meta.config, lambda a, b: arrays.read_rows(path, at, a, b)).agg(F.sum("n_bad")).first()[0]
        except Exception as e:
            raise IntegrityError(f"the compressed signal can't be read: {str(e)[:300]}") from e
        if bad or at.n_rows != self.meta.n_samples:
            raise IntegrityError(f"{bad or 'some'} samples differ from {path}")

    def damaged(self) -> DataFrame:
        """chunk_idx of chunks whose payload does not match its digest or, where none is stored, can't be inflated."""
        return damaged_frame(self.chunks, self.meta.dtype, self.meta.n_channels)

    def check_file_digest(self) -> None:
        """Raise IntegrityError if the header has a digest of the compressed file and the chunks don't have it."""
        if self.meta.sha1_compressed not in (None, self.sha1_compressed()):
            raise IntegrityError("the compressed file does not have the digest in its header")

    def sha1_uncompressed(self) -> str:
        """SHA-1 of the signal as one flat file."""
        return _sha1(decode_bytes_frame(self.chunks, self.meta.dtype, self.meta.n_channels, self.meta.config))

    def sha1_compressed(self) -> str:
        """SHA-1 of all payloads in order of chunks."""
        return _sha1(self.chunks.select("chunk_idx", "payload"))


def _sha1(payloads: DataFrame) -> str:
    """SHA-1 of the payloads in order of chunk_idx: a fold in one task, as its nature is; only the digest reaches the driver."""

    def fold(batches):
        whole = hashlib.sha1()
        for batch in batches:
            for payload in batch.column(1):
                whole.update(payload.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()])], names=["sha1"])

    found = payloads.repartition(1).sortWithinPartitions("chunk_idx").mapInArrow(fold, "sha1 string").first()
    return found[0] if found else hashlib.sha1().hexdigest()


def compress(spark: SparkSession, path: str, out: str | None = None, outmeta: str | None = None, sample_rate: float | None = None, n_channels: int | None = None, dtype: str | None = None, offset: int = 0, before_check=None, overwrite: bool = False, **settings) -> dict:
    """Encode a flat binary or NPY file to a compressed file and header; checks the result and returns its figures."""
    npy = path.lower().endswith(".npy")
    store = SignalStore.from_npy(spark, path, sample_rate, **settings) if npy else SignalStore.from_raw(spark, path, sample_rate, n_channels, dtype, offset, **settings)
    out = out or files.with_suffix(path, ".cnpy" if npy else ".cbin")
    outmeta = outmeta or arrays.default_header(out)
    figures = store.write_cbin(out, outmeta, overwrite)
    if store.meta.config.check_after_compress:
        again = SignalStore.open_cbin(spark, out, outmeta)
        at = arrays.npy_layout(path) if npy else arrays.raw_layout(path, store.meta.dtype if dtype is None else dtype, store.meta.n_channels, offset)
        if before_check is not None:
            before_check(again)
        again.verify_file(path, at)
    return figures | {"out": out, "outmeta": outmeta}


def decompress(spark: SparkSession, cdata: str, cmeta=None, out: str | None = None, write_output: bool = False, overwrite: bool = False, **settings) -> SignalStore:
    """Open a compressed file and, if asked or if ``out`` is given, write it as a flat file; see open_cbin() for settings."""
    store = SignalStore.open_cbin(spark, cdata, cmeta, **settings)
    if write_output or out is not None:
        store.tofile(out or files.with_suffix(cdata, ".bin"), overwrite)
    return store
