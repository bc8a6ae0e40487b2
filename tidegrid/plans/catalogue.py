"""The registered queries over signals, and their DuckDB equivalents.

Two tables serve as signals. EVT is ``events`` by event_id: cents, user and k, chunks of 1000 samples. EMB is
``embeddings`` by vec_id, on the int16 scale, chunks of 100. Results are in long form.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import delta, dtypes
from tidegrid.functions import sql as sqlfuncs
from tidegrid.operators.codec import decode_frame
from tidegrid.operators.store import SignalStore, compress, decompress
from tidegrid.plans import chunking
from tidegrid.plans.config import CodecConfig
from tidegrid.plans.workspace import scratch
from tidegrid.sources import arrays, files, sinks
from tidegrid.streaming.encoder import encode_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

EVT_RATE, EVT_SIZE, EMB_SIZE = 1000.0, 1000, 100
INT16, INT32 = dtypes.sample_type("int16"), dtypes.sample_type("int32")

EVT_SQL = """evt as (
  select event_id as t, 0 as channel, cast(round(value * 100) as int) as value from events
  union all select event_id, 1, cast(user_id as int) from events
  union all select event_id, 2, cast(regexp_extract(props, '[0-9]+') as int) from events)"""
EMB_SQL = "emb as (select vec_id as t, cast(i - 1 as int) as channel, cast(trunc(cast(embedding[i] as double) * 32766) as int) as value from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))"
LONG = "select t, channel, value from"


def query(name: str, oracle: str | None = None):
    """Register a query and, if SQL can express it, its oracle."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVT as (t, samples)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "[0-9]+", 0)
    return e.select(F.col("event_id").alias("t"), F.array(F.round(F.col("value") * 100).cast("int"), F.col("user_id").cast("int"), k.cast("int")).alias("samples"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB as (t, samples)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("t"), F.transform("embedding", lambda x: dtypes.quantise(x, 1.0)).alias("samples"))


def long(wide: DataFrame) -> DataFrame:
    return delta.to_long(wide).select("t", "channel", F.col("value").cast("int").alias("value"))


def store(spark: SparkSession, sf_dir: str, **settings) -> SignalStore:
    return SignalStore.encode(evt(spark, sf_dir), "int32", EVT_RATE, chunk_duration=EVT_SIZE / EVT_RATE, **settings)


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> SignalStore:
    """EVT as a stored table, written once per application: slices prune it, which they can't an encoding in flight."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        folder = scratch(spark, "signal")
        store(spark, sf_dir).save(folder)
        _stored[key] = folder
    return SignalStore.open(spark, _stored[key])


# scans


@query("scan_wide", "select event_id as t, cast(round(value * 100) as int) as cents, cast(user_id as int) as user_id, cast(regexp_extract(props, '[0-9]+') as int) as k from events")
def scan_wide(spark, sf_dir):
    return evt(spark, sf_dir).select("t", *[F.get("samples", F.lit(i)).alias(n) for i, n in enumerate(("cents", "user_id", "k"))])


@query("scan_long", f"with {EVT_SQL} {LONG} evt")
def scan_long(spark, sf_dir):
    return long(evt(spark, sf_dir))


# scalar functions


@query("quantize_int16", f"with {EMB_SQL} {LONG} emb")
def quantize_int16(spark, sf_dir):
    return long(emb(spark, sf_dir))


@query("dequantize_int16", f"with {EMB_SQL} select t, channel, cast(trunc(value * (1.0::double / 32766) * 1e6) as int) as micro from emb")
def dequantize_int16(spark, sf_dir):
    return delta.to_long(emb(spark, sf_dir)).select("t", "channel", (dtypes.dequantise(F.col("value"), 1.0) * 1e6).cast("int").alias("micro"))


@query("sql_functions", f"with {EMB_SQL} select t, channel, cast(value * 7919 & 65535 as int) as u16, cast(t // 100 as int) as chunk_idx from emb")
def sql_functions(spark, sf_dir):
    sqlfuncs.register(spark)
    return long(emb(spark, sf_dir)).select("t", "channel", F.expr("wrap_uint16(value * 7919L)").alias("u16"), F.expr("chunk_of(t, 100)").alias("chunk_idx"))


@query("max_abs", f"with {EMB_SQL} select cast(max(abs(value)) as int) as peak from emb")
def max_abs(spark, sf_dir):
    return emb(spark, sf_dir).agg(F.max(F.aggregate(F.col("samples"), F.lit(0), lambda a, x: F.greatest(a, F.abs(x.cast("int"))))).alias("peak"))


# chunks


@query("chunk_bounds", f"select cast(event_id // {EVT_SIZE} as int) as chunk_idx, min(event_id) as t0, max(event_id) + 1 as t1, count(*) as n_rows from events group by 1")
def chunk_bounds(spark, sf_dir):
    return chunking.bounds_frame(evt(spark, sf_dir), EVT_SIZE)


@query("chunk_iter", f"select cast(event_id // {EVT_SIZE} as int) as chunk_idx, min(event_id) as t0, max(event_id) + 1 as t1 from events where event_id // {EVT_SIZE} between 0 and 2 group by 1")
def chunk_iter(spark, sf_dir):
    return store(spark, sf_dir).index().where(F.col("chunk_idx").between(0, 2)).select("chunk_idx", "t0", "t1")


_INTERVALS = ((-1, 2), (0, 0), (2, 1), (999, 999), (999, 1000), (1000, 1000), (-10000, 10000000), (1000, 10000000), (123456789, 123456790))


@query(
    "chunk_lookup",
    f"""with n as (select max(event_id) as last from events), i(i0, i1) as (values {', '.join(map(str, _INTERVALS))}),
c as (select i0, i1, greatest(0, least(i0, last)) as a, greatest(0, least(i1, last)) as b from i, n)
select cast(i0 as bigint) as i0, cast(i1 as bigint) as i1, cast(a // {EVT_SIZE} as int) as first, cast(greatest(a, b) // {EVT_SIZE} as int) as last from c""",
)
def chunk_lookup(spark, sf_dir):
    n = evt(spark, sf_dir).agg(F.max("t") + 1).first()[0]
    return spark.createDataFrame([(a, b, *chunking.chunk_span(n, EVT_SIZE, a, b)) for a, b in _INTERVALS], "i0 bigint, i1 bigint, first int, last int")


@query("chunk_sha1_uncompressed", f"with {EVT_SQL}, h as (select t, channel, printf('%08x', value) as x from evt) select cast(t // {EVT_SIZE} as int) as chunk_idx, sha1(unhex(string_agg(substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2), '' order by t, channel))) as sha1_raw from h group by 1")
def chunk_sha1_uncompressed(spark, sf_dir):
    return store(spark, sf_dir).chunks.select("chunk_idx", "sha1_raw")


@query(
    "chunk_offsets",
    f"""select cast(event_id // {EVT_SIZE} as int) as chunk_idx, min(event_id) as t0, max(event_id) + 1 as t1, min(event_id) = 0 as at_zero, true as follows from events group by 1""",
)
def chunk_offsets(spark, sf_dir):
    """Where each chunk's bytes begin: at 0 or right behind the chunk before it. How many there are is deflate's affair."""
    own = stored(spark, sf_dir).index()
    end = own.select((F.col("chunk_idx") + 1).alias("chunk_idx"), (F.col("byte_offset") + F.col("byte_length")).alias("end"))
    follows = (F.col("byte_offset") == F.coalesce("end", F.lit(0))) & (F.col("byte_length") > 0)
    return own.join(end, "chunk_idx", "left").select("chunk_idx", "t0", "t1", (F.col("byte_offset") == 0).alias("at_zero"), follows.alias("follows"))


@query("compression_stats", "select cast(count(*) * 12 as bigint) as raw_bytes, true as smaller, true as ratio_fits from events")
def compression_stats(spark, sf_dir):
    own = stored(spark, sf_dir).compression_stats()
    return own.select("raw_bytes", (F.col("compressed_bytes") < F.col("raw_bytes")).alias("smaller"), (F.col("ratio") == F.col("compressed_bytes") / F.col("raw_bytes")).alias("ratio_fits"))


# differences and prefix sums

_TIME = "value - coalesce(lag(value) over (partition by channel, t // {} order by t), 0)"
_SPACE = "value - coalesce(lag(value) over (partition by t order by channel), 0)"


@query("time_diff", f"with {EMB_SQL} select t, channel, cast(((({_TIME.format(EMB_SIZE)}) + 32768) % 65536 + 65536) % 65536 - 32768 as int) as value from emb")
def time_diff(spark, sf_dir):
    return delta.time_diff(delta.to_long(emb(spark, sf_dir)), INT16, EMB_SIZE).withColumn("value", F.col("value").cast("int"))


@query("time_diff_wide", ORACLE_SQL["time_diff"])
def time_diff_wide(spark, sf_dir):
    return long(delta.wide_time_diff(emb(spark, sf_dir), INT16, EMB_SIZE))


@query("spatial_diff", f"with {EMB_SQL} select t, channel, cast(((({_SPACE}) + 32768) % 65536 + 65536) % 65536 - 32768 as int) as value from emb")
def spatial_diff(spark, sf_dir):
    return delta.spatial_diff(delta.to_long(emb(spark, sf_dir)), INT16).withColumn("value", F.col("value").cast("int"))


@query("spatial_diff_wide", ORACLE_SQL["spatial_diff"])
def spatial_diff_wide(spark, sf_dir):
    return long(delta.wide_spatial_diff(emb(spark, sf_dir), INT16))


@query("time_spatial_diff", f"with {EVT_SQL}, d as (select t, channel, {_TIME.format(EVT_SIZE)} as value from evt) select t, channel, cast({_SPACE} as int) as value from d")
def time_spatial_diff(spark, sf_dir):
    return long(delta.wide_spatial_diff(delta.wide_time_diff(evt(spark, sf_dir), INT32, EVT_SIZE), INT32))


@query("time_cumsum", f"with {EVT_SQL} select t, channel, cast(sum(value) over (partition by channel, t // {EVT_SIZE} order by t) as int) as value from evt")
def time_cumsum(spark, sf_dir):
    return delta.time_cumsum(delta.to_long(evt(spark, sf_dir)), INT32, EVT_SIZE)


@query("spatial_cumsum", f"with {EVT_SQL} select t, channel, cast(sum(value) over (partition by t order by channel) as int) as value from evt")
def spatial_cumsum(spark, sf_dir):
    return delta.spatial_cumsum(delta.to_long(evt(spark, sf_dir)), INT32)


@query("spatial_cumsum_wide", ORACLE_SQL["spatial_cumsum"])
def spatial_cumsum_wide(spark, sf_dir):
    return long(delta.wide_spatial_cumsum(evt(spark, sf_dir), INT32))


@query("wrap_diff_u8", f"with {EVT_SQL}, u as (select t, channel, value & 255 as value from evt) select t, channel, cast(({_TIME.format(EVT_SIZE)}) & 255 as int) as value from u")
def wrap_diff_u8(spark, sf_dir):
    own = delta.to_long(evt(spark, sf_dir)).withColumn("value", F.col("value").bitwiseAND(255).cast("smallint"))
    return delta.time_diff(own, dtypes.sample_type("uint8"), EVT_SIZE).withColumn("value", F.col("value").cast("int"))


_I16 = "cast(((value::bigint * 7919 + 32768) & 65535) - 32768 as int)"


@query("wrap_diff_i16", f"with {EVT_SQL}, u as (select t, channel, {_I16} as value from evt) select t, channel, cast(((({_TIME.format(EVT_SIZE)}) + 32768) & 65535) - 32768 as int) as value from u")
def wrap_diff_i16(spark, sf_dir):
    own = delta.to_long(evt(spark, sf_dir)).withColumn("value", dtypes.wrap(F.col("value").cast("bigint") * 7919, INT16))
    return delta.time_diff(own, INT16, EVT_SIZE).withColumn("value", F.col("value").cast("int"))


# round trips


def _round_trip(**settings):
    def run(spark, sf_dir):
        return long(store(spark, sf_dir, **settings).decode())

    return run


for _name, _settings in {
    "roundtrip_time": {},
    "roundtrip_spatial": {"do_time_diff": False, "do_spatial_diff": True},
    "roundtrip_both": {"do_spatial_diff": True},
    "roundtrip_none": {"do_time_diff": False},
    "roundtrip_order_c": {"chunk_order": "C"},
    "roundtrip_order_f": {"chunk_order": "F", "comp_level": 9},
}.items():
    query(_name, ORACLE_SQL["scan_long"])(_round_trip(**_settings))


@query("roundtrip_stored", ORACLE_SQL["scan_long"])
def roundtrip_stored(spark, sf_dir):
    return long(store(spark, sf_dir).save(scratch(spark, "signal")).decode())


@query("concat_chunks", ORACLE_SQL["scan_long"])
def concat_chunks(spark, sf_dir):
    """UNION ALL of two parts of a signal, decoded apart."""
    own = store(spark, sf_dir)
    return long(own[:EVT_SIZE].unionByName(own[EVT_SIZE:]))


@query("stream_roundtrip", ORACLE_SQL["scan_long"])
def stream_roundtrip(spark, sf_dir):
    """All chunks that the streaming encoder emits, decoded (an extension)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    samples = stream.select(F.col("event_id").alias("t"), F.array(F.round(F.col("value") * 100).cast("int"), F.col("user_id").cast("int"), k).alias("samples"))
    out = scratch(spark, "stream")
    chunks = encode_stream(samples, "int32", 3, EVT_SIZE, n_samples=evt(spark, sf_dir).count())
    chunks.writeStream.format("parquet").option("checkpointLocation", out + "/state").trigger(availableNow=True).start(out + "/chunks").awaitTermination()
    return long(decode_frame(spark.read.parquet(out + "/chunks"), "int32", 3, CodecConfig()))


# slices


def _slice(name: str, where: str, pick) -> None:
    query(name, f"with {EVT_SQL}, n as (select max(event_id) + 1 as n from events) {LONG} evt, n where {where}")(lambda spark, sf_dir: long(pick(stored(spark, sf_dir))))


_slice("slice_range", "t >= 250 and t < 425", lambda s: s[250:425])
_slice("slice_across_chunks", "t >= 950 and t < 2050", lambda s: s[950:2050])
_slice("slice_step", "t >= 7 and t < 900 and (t - 7) % 13 = 0", lambda s: s[7:900:13])
_slice("slice_long_step", "t >= 3 and (t - 3) % 1234 = 0", lambda s: s[3::1234])
_slice("slice_negative", "t >= n - 150 and t < n - 1", lambda s: s[-150:-1])
_slice("slice_beyond", "t >= n - 10", lambda s: s[-10:10**9])
_slice("slice_all", "true", lambda s: s[:])
_slice("slice_tuple", "t < 5", lambda s: s[(slice(None, 5),)])
_slice("row_at", "t = 17", lambda s: s[17])
_slice("row_at_negative", "t = n - 1", lambda s: s[-1])
_slice("row_at_negative_wrap", "t = n - 1", lambda s: s[-s.meta.n_samples - 1])
_slice("decode_chunk_set", f"t // {EVT_SIZE} in (0, 2, 3)", lambda s: s.decode_chunks([0, 2, 3]))
_slice("get_chunk", f"t // {EVT_SIZE} = 0", lambda s: s.get_chunk(0))
_slice("take_rows", "t % 97 = 5", lambda s: s.take(s.spark.range(5, s.meta.n_samples, 97).withColumnRenamed("id", "t")))


@query("slice_stored_pruned", ORACLE_SQL["slice_across_chunks"])
def slice_stored_pruned(spark, sf_dir):
    return long(stored(spark, sf_dir)[950:2050])


@query("chop_prefix", f"with {EVT_SQL}, n as (select greatest(1, least(3, (max(event_id) + 1) // {EVT_SIZE})) as kept from events) {LONG} evt, n where t < kept * {EVT_SIZE}")
def chop_prefix(spark, sf_dir):
    own = stored(spark, sf_dir)
    return long((own.chop(min(3, max(1, own.meta.n_samples // EVT_SIZE))) or own).decode())


@query("cell_at", f"with {EVT_SQL} select t, value from evt where t = 42 and channel = 1")
def cell_at(spark, sf_dir):
    return stored(spark, sf_dir)[42, 1]


@query("channel_project", f"with {EVT_SQL} select t, value from evt where channel = 0")
def channel_project(spark, sf_dir):
    return stored(spark, sf_dir)[:, 0]


@query("channel_slice", f"with {EVT_SQL} select t, cast(channel // 2 as int) as channel, value from evt where channel in (0, 2)")
def channel_slice(spark, sf_dir):
    return long(stored(spark, sf_dir)[:, ::2])


@query("channel_list", f"with {EVT_SQL} select t, case channel when 2 then 0 else 1 end as channel, value from evt where channel in (2, 0) and t >= 100 and t < 300")
def channel_list(spark, sf_dir):
    return long(stored(spark, sf_dir)[100:300, [2, 0]])


# facts and checks


@query("describe_signal", f"select 'int32' as dtype, cast(1000.0 as double) as sample_rate, 3 as n_channels, printf('%.1fs', (max(event_id) + 1) / 1000.0) as duration, count(*) as n_samples, printf('%.1fs', count(*) / count(distinct event_id // {EVT_SIZE}) / 1000.0) as chunk_duration, count(distinct event_id // {EVT_SIZE}) as n_chunks from events")
def describe_signal(spark, sf_dir):
    return store(spark, sf_dir).describe()


@query("mean_chunk_duration", f"select cast(round(1e6 * avg(n) / 1000.0) as bigint) as micros from (select count(*) as n from events group by event_id // {EVT_SIZE})")
def mean_chunk_duration(spark, sf_dir):
    return store(spark, sf_dir).chunks.agg(F.round(F.avg(F.col("t1") - F.col("t0")) / EVT_RATE * 1e6).cast("bigint").alias("micros"))


@query("verify_integrity", "select event_id as t from events where event_id % 997 = 3")
def verify_integrity(spark, sf_dir):
    """Samples that differ from an original of which some rows were altered: exactly these."""
    altered = F.when(F.col("t") % 997 == 3, F.transform("samples", lambda x: x + 1)).otherwise(F.col("samples"))
    return stored(spark, sf_dir).violations(evt(spark, sf_dir).withColumn("samples", altered))


@query("verify_missing", "select event_id as t from events where event_id % 500 = 7")
def verify_missing(spark, sf_dir):
    """Samples that the original lacks."""
    return stored(spark, sf_dir).violations(evt(spark, sf_dir).where("t % 500 <> 7"))


@query("verify_float_tolerance", "select vec_id as t from embeddings where vec_id % 10 = 5")
def verify_float_tolerance(spark, sf_dir):
    """A floating-point signal against two kinds of errors: within tolerance, which pass, and beyond it, which don't."""
    wide = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.transform("embedding", lambda x: x.cast("double") + 2).alias("samples"))
    own = SignalStore.encode(wide, "float64", 100.0, do_time_diff=False)
    error = F.when(F.col("t") % 10 == 5, 1.001).when(F.col("t") % 10 == 0, 1 + 1e-7).otherwise(1.0)
    return own.violations(wide.withColumn("samples", F.transform("samples", lambda x: x * error)))


_SPOILED = f"select distinct cast(event_id // {EVT_SIZE} as int) as chunk_idx from events where event_id // {EVT_SIZE} in (0, 2)"


@query("damaged_chunks", _SPOILED)
def damaged_chunks(spark, sf_dir):
    """Chunks whose payload was spoiled behind its digest: exactly these."""
    own = stored(spark, sf_dir)
    spoiled = F.when(F.col("chunk_idx").isin(0, 2), F.expr("overlay(payload placing x'00ff00' from 11)")).otherwise(F.col("payload"))
    return SignalStore(own.chunks.withColumn("payload", spoiled), own.meta).damaged()


@query("damaged_without_digest", _SPOILED)
def damaged_without_digest(spark, sf_dir):
    """The same where no digest is stored, as in a compressed file: what can't be inflated is damaged."""
    own = stored(spark, sf_dir)
    spoiled = F.when(F.col("chunk_idx").isin(0, 2), F.expr("overlay(payload placing x'00ff00' from 11)")).otherwise(F.col("payload"))
    return SignalStore(own.chunks.withColumn("payload", spoiled).withColumn("sha1", F.lit(None).cast("string")), own.meta).damaged()


# files


def raw_file(spark: SparkSession, sf_dir: str) -> str:
    """EVT as a flat binary file."""
    path = scratch(spark, "file") + "/x.bin"
    sinks.write_ordered(evt(spark, sf_dir), "t", "tidegrid_raw_sink", False, path=path, dtype="int32")
    return path


def compressed_file(spark: SparkSession, sf_dir: str, **settings) -> dict:
    """EVT as a compressed file, written and checked; gives figures and names."""
    return compress(spark, raw_file(spark, sf_dir), sample_rate=EVT_RATE, n_channels=3, dtype="int32", chunk_duration=EVT_SIZE / EVT_RATE, **settings)


@query("raw_roundtrip", ORACLE_SQL["scan_long"])
def raw_roundtrip(spark, sf_dir):
    return long(arrays.load_raw(spark, raw_file(spark, sf_dir), "int32", 3))


@query("raw_encode", ORACLE_SQL["chunk_sha1_uncompressed"])
def raw_encode(spark, sf_dir):
    """Chunks of a flat file, encoded by tasks that read their own byte ranges."""
    own = SignalStore.from_raw(spark, raw_file(spark, sf_dir), EVT_RATE, 3, "int32", chunk_duration=EVT_SIZE / EVT_RATE)
    return own.chunks.select("chunk_idx", "sha1_raw")


@query("npy_roundtrip", ORACLE_SQL["scan_long"])
def npy_roundtrip(spark, sf_dir):
    """An NPY array of three dimensions, flattened to the last, compressed to a file and decoded."""
    path = scratch(spark, "file") + "/x.npy"
    n = evt(spark, sf_dir).count()
    sinks.write_ordered(evt(spark, sf_dir), "t", "tidegrid_npy_sink", False, path=path, dtype="int32", shape=f"[{n}, 1, 3]")
    figures = compress(spark, path, sample_rate=EVT_RATE, chunk_duration=EVT_SIZE / EVT_RATE)
    return long(SignalStore.open_cbin(spark, figures["out"], figures["outmeta"]).decode())


@query("npy_source", ORACLE_SQL["scan_long"])
def npy_source(spark, sf_dir):
    path = scratch(spark, "file") + "/x.npy"
    n = evt(spark, sf_dir).count()
    sinks.write_ordered(evt(spark, sf_dir), "t", "tidegrid_npy_sink", False, path=path, dtype="int32", shape=f"[{n}, 3]")
    return long(arrays.load_npy(spark, path))


@query("cbin_roundtrip", ORACLE_SQL["scan_long"])
def cbin_roundtrip(spark, sf_dir):
    figures = compressed_file(spark, sf_dir, do_spatial_diff=True)
    own = SignalStore.open_cbin(spark, figures["out"], figures["outmeta"])
    own.check_file_digest()
    return long(own.decode())


@query("cbin_slice", ORACLE_SQL["slice_across_chunks"])
def cbin_slice(spark, sf_dir):
    """A slice of a compressed file: only byte ranges of chunks that it touches are read."""
    figures = compressed_file(spark, sf_dir)
    return long(SignalStore.open_cbin(spark, figures["out"])[950:2050])


@query("tofile_bytes", ORACLE_SQL["chunk_sha1_uncompressed"])
def tofile_bytes(spark, sf_dir):
    """SHA-1 of each chunk's rows of the flat file that decompressing writes."""
    figures = compressed_file(spark, sf_dir)
    out = scratch(spark, "file") + "/y.bin"
    decompress(spark, figures["out"], out=out)
    return SignalStore.from_raw(spark, out, EVT_RATE, 3, "int32", chunk_duration=EVT_SIZE / EVT_RATE).chunks.select("chunk_idx", "sha1_raw")


@query("chop_file", ORACLE_SQL["chop_prefix"])
def chop_file(spark, sf_dir):
    """The first chunks of a compressed file as another file."""
    figures = compressed_file(spark, sf_dir)
    own = SignalStore.open_cbin(spark, figures["out"])
    kept = own.chop(min(3, max(1, own.meta.n_samples // EVT_SIZE)))
    if kept is None:
        return long(own.decode())
    out = scratch(spark, "file") + "/z.cbin"
    kept.write_cbin(out)
    return long(SignalStore.open_cbin(spark, out).decode())


@query(
    "header_fields",
    f"""select '1.0' as version, 'zlib' as algorithm, '<i4' as dtype, 3 as n_channels, cast(1000.0 as double) as sample_rate, 'F' as chunk_order, true as do_time_diff, false as do_spatial_diff,
count(*) as n_samples, count(distinct event_id // {EVT_SIZE}) + 1 as n_bounds, count(distinct event_id // {EVT_SIZE}) + 1 as n_offsets, true as digest_fits from events""",
)
def header_fields(spark, sf_dir):
    """The header of a compressed file, and whether its digest is that of the file."""
    figures = compressed_file(spark, sf_dir)
    h = json.loads(files.read_all(figures["outmeta"]))
    fits = h["sha1_compressed"] == hashlib.sha1(files.read_all(figures["out"])).hexdigest() and h["chunk_offsets"][-1] == files.size(figures["out"])
    row = (h["version"], h["algorithm"], np.dtype(h["dtype"]).str, h["n_channels"], h["sample_rate"], h["chunk_order"], h["do_time_diff"], h["do_spatial_diff"], h["chunk_bounds"][-1], len(h["chunk_bounds"]), len(h["chunk_offsets"]), fits)
    return spark.createDataFrame([row], "version string, algorithm string, dtype string, n_channels int, sample_rate double, chunk_order string, do_time_diff boolean, do_spatial_diff boolean, n_samples bigint, n_bounds bigint, n_offsets bigint, digest_fits boolean")
