"""Differential tests against NumPy, with seeded inputs."""

import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import delta, dtypes
from tidegrid.operators.codec import IntegrityError, compress_chunk, decompress_chunk, difference, prefix_sum
from tidegrid.operators.store import SignalStore, compress, decompress
from tidegrid.plans import chunking
from tidegrid.plans.config import CodecConfig
from tidegrid.sources import arrays, sinks
from tidegrid.streaming.encoder import encode_stream

INTS = ["int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64"]


@pytest.fixture(autouse=True)
def no_user_file(tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEGRID_CONFIG", str(tmp_path / "config.json"))


def full_range(dtype, shape, seed=1):
    info = np.iinfo(dtype)
    return np.random.default_rng(seed).integers(info.min, info.max, shape, dtype=dtype, endpoint=True)


def frame(spark, x):
    kind = dtypes.sample_type(x.dtype)
    rows = [(t, [float(v) if kind.floating else int(v) for v in r]) for t, r in enumerate(x)]
    if kind.name == "uint64":
        from decimal import Decimal

        rows = [(t, [Decimal(v) for v in r]) for t, r in rows]
    return spark.createDataFrame(rows, f"t bigint, samples array<{kind.spark.simpleString()}>").repartition(3)


def back(df, dtype):
    rows = df.orderBy("t").collect()
    return np.array([[int(v) if np.dtype(dtype).kind in "iu" else v for v in r.samples] for r in rows], dtype=dtype)


@pytest.mark.parametrize("dtype", INTS)
@pytest.mark.parametrize("axes", [(None, None), (0, None), (None, 1), (0, 1)])
def test_difference_and_sum_are_inverse(dtype, axes):
    x = full_range(dtype, (50, 7))
    x[::2], x[1::2] = np.iinfo(dtype).min, np.iinfo(dtype).max
    y = difference(difference(x, axes[0]), axes[1])
    assert y.dtype == x.dtype and (prefix_sum(prefix_sum(y, axes[1]), axes[0]) == x).all()
    if axes[0] == 0:
        assert (y[0, 0] == x[0, 0]) and (y[1:, 0] == np.diff(x, axis=0)[:, 0]).all()


@pytest.mark.parametrize("dtype", INTS)
def test_native_expressions_wrap_like_numpy(spark, dtype):
    x = full_range(dtype, (60, 5), seed=2)
    x[5], x[6] = np.iinfo(dtype).min, np.iinfo(dtype).max
    kind, size = dtypes.sample_type(dtype), 20
    wide = frame(spark, x)
    want = np.concatenate([difference(x[a : a + size], 0) for a in range(0, 60, size)])
    assert (back(delta.wide_time_diff(wide, kind, size), dtype) == want).all()
    assert (back(delta.to_wide(delta.time_diff(delta.to_long(wide), kind, size)), dtype) == want).all()
    assert (back(delta.to_wide(delta.time_cumsum(delta.to_long(frame(spark, want)), kind, size)), dtype) == x).all()
    across = difference(x, 1)
    assert (back(delta.wide_spatial_diff(wide, kind), dtype) == across).all()
    assert (back(delta.wide_spatial_cumsum(frame(spark, across), kind), dtype) == x).all()
    assert (back(delta.to_wide(delta.spatial_cumsum(delta.to_long(frame(spark, across)), kind)), dtype) == x).all()


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("level", [-1, 1, 9])
def test_codec_bytes(order, level):
    x = full_range("int16", (40, 3))
    data = compress_chunk(x, True, True, order, level)
    assert data == zlib.compress(difference(difference(x, 0), 1).tobytes(order), level)
    assert (decompress_chunk(data, 40, 3, "int16", True, True, order) == x).all()
    with pytest.raises(IntegrityError):
        decompress_chunk(data[:-3], 40, 3, "int16", True, True, order)
    with pytest.raises(IntegrityError):
        decompress_chunk(data, 40, 4, "int16", True, True, order)


@pytest.mark.parametrize("dtype", [*INTS, "float32", "float64"])
def test_round_trip(spark, dtype):
    x = full_range(dtype, (100, 4)) if dtype in INTS else np.random.default_rng(3).normal(0, 0.25, (100, 4)).astype(dtype)
    store = SignalStore.encode(frame(spark, x), dtype, 30.0, do_time_diff=dtype in INTS, do_spatial_diff=dtype in INTS)
    assert store.shape == (100, 4) and store.meta.n_chunks == 4
    assert (back(store.decode(), dtype) == x).all()
    store.verify(frame(spark, x))
    assert store.violations(frame(spark, np.delete(x, 7, axis=0)).where("t <> 50")).count() > 0


def test_indexing_like_numpy(spark):
    n, c = 97, 5
    x = full_range("int16", (n, c), seed=4)
    store = SignalStore.encode(frame(spark, x), "int16", 10.0)
    store.chunks = store.chunks.cache()
    rng = random.Random(5)
    bounds = [None, 0, 1, -1, 9, 10, 11, -97, 200, -200]
    for _ in range(25):
        s = slice(rng.choice(bounds), rng.choice(bounds), rng.choice([None, 1, 2, 3, 13, 97]))
        got = back(store[s], "int16").reshape(-1, c)
        assert (got == x[s]).all() and len(got) == len(x[s]), s
    for i in (0, 9, 10, -1, -97, np.int8(3), np.uint64(96)):
        assert (back(store[i], "int16")[0] == x[i]).all()
    assert (back(store[-98], "int16")[0] == x[-1]).all()
    for across in (slice(1, -1, 2), [1, 4, 3], slice(None, None, -1)):
        assert (back(store[5:40, across], "int16") == x[5:40, across]).all()
    assert [r.value for r in store[20:30, -2].orderBy("t").collect()] == x[20:30, -2].tolist()
    assert store[3, 2].first().value == x[3, 2]
    assert (back(store.take(spark.createDataFrame([(3,), (55,), (3,)], "t bigint")), "int16") == x[[3, 55]]).all()
    for bad, error in ((97, IndexError), (1.5, TypeError), (None, TypeError), (Ellipsis, TypeError), ([1, 2], NotImplementedError), (slice(0, 5, -1), ValueError), (slice(0, 5, 0), ValueError), ((1, 2, 3), TypeError)):
        with pytest.raises(error):
            store[bad]
    with pytest.raises(IndexError):
        store[0, 5]


def test_chunk_span():
    bounds = chunking.bounds(6997, 1234)
    assert bounds == [0, 1234, 2468, 3702, 4936, 6170, 6997]
    # fixed values: sample intervals with both ends included, and their first and last chunk
    table = [(-1, 2, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0), (2, 1, 0, 0), (2, -1, 0, 0), (2, 2, 0, 0), (1233, 1233, 0, 0), (1233, 1234, 0, 1), (1234, 1234, 1, 1), (1234, 1235, 1, 1), (-10000, 10000, 0, 5), (0, 10000, 0, 5), (1233, 10000, 0, 5), (1234, 10000, 1, 5), (6996, 10000, 5, 5), (6997, 10000, 5, 5), (6998, 10000, 5, 5)]
    for a, b, first, last in table:
        assert chunking.chunk_span(6997, 1234, a, b) == (first, last), (a, b)
    assert chunking.chunk_size(0.5, 5.0) == 2 and chunking.chunk_size(0.7, 5.0) == 4
    with pytest.raises(ValueError):
        chunking.chunk_size(0.01, 1.0)


def test_slice_reads_only_its_chunks(spark, tmp_path):
    x = full_range("int16", (100, 2))
    store = SignalStore.encode(frame(spark, x), "int16", 10.0).save(f"file://{tmp_path}/s")
    part = store[19:20]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "chunk_idx" in plan.split("PushedFilters")[1]
    assert store._pruned(chunking.rows_of(slice(19, 20), 100)).count() == 1
    assert (back(part, "int16") == x[19:20]).all()


def test_compressed_file(spark, tmp_path):
    x = full_range("int16", (1000, 10), seed=6) % 255
    path = str(tmp_path / "x.bin")
    x.tofile(path)
    figures = compress(spark, path, sample_rate=100.0, n_channels=10, dtype="int16")
    import hashlib

    header = json.loads((tmp_path / "x.ch").read_text())
    data = (tmp_path / "x.cbin").read_bytes()
    assert header["chunk_bounds"] == list(range(0, 1001, 100)) and header["chunk_offsets"][-1] == len(data) == figures["bytes"]
    assert header["sha1_compressed"] == hashlib.sha1(data).hexdigest() and header["sha1_uncompressed"] == hashlib.sha1(x.tobytes()).hexdigest()
    assert data == b"".join(zlib.compress(difference(x[a : a + 100], 0).tobytes("F"), -1) for a in range(0, 1000, 100))
    store = decompress(spark, str(tmp_path / "x.cbin"), out=str(tmp_path / "y.bin"))
    assert (tmp_path / "y.bin").read_bytes() == x.tobytes()
    with pytest.raises(FileExistsError):
        store.tofile(str(tmp_path / "y.bin"))
    store.tofile(str(tmp_path / "y.bin"), overwrite=True)
    assert list(store.iter_chunks(2, 3))[0][:2] == (2, header["chunk_offsets"][2])
    assert store.damaged().count() == 0 and store.sha1_compressed() == header["sha1_compressed"]
    # the first five chunks are what encoding the first 500 rows gives
    store.chop(5).write_cbin(str(tmp_path / "z.cbin"))
    z = json.loads((tmp_path / "z.ch").read_text())
    assert (tmp_path / "z.cbin").read_bytes() == data[: header["chunk_offsets"][5]] and z["chopped"] and z["sha1_compressed"] is None
    assert store.chop(10) is None
    with pytest.raises(ValueError):
        store.chop(0)
    spoiled = bytearray(data)
    spoiled[len(data) // 2] ^= 255
    (tmp_path / "x.cbin").write_bytes(spoiled)
    broken = SignalStore.open_cbin(spark, str(tmp_path / "x.cbin"))
    with pytest.raises(IntegrityError):
        broken.verify(arrays.load_raw(spark, path, "int16", 10))
    with pytest.raises(IntegrityError):
        broken.verify_file(path, arrays.raw_layout(path, "int16", 10))
    with pytest.raises(IntegrityError):
        broken.check_file_digest()
    at = next(i for i in range(10) if header["chunk_offsets"][i + 1] > len(data) // 2)
    assert [r[0] for r in broken.damaged().collect()] == [at]
    # a header as a dict, settings of reading, names without a suffix
    (tmp_path / "x.cbin").write_bytes(data)
    own = SignalStore.open_cbin(spark, str(tmp_path / "x.cbin"), header, check_after_decompress=False)
    assert not own.meta.config.check_after_decompress and (back(own[5:25], "int16") == x[5:25]).all()
    with pytest.raises(ValueError, match="not settings of reading"):
        decompress(spark, str(tmp_path / "x.cbin"), chunk_order="C")
    (tmp_path / "d.d").mkdir()
    x.tofile(tmp_path / "d.d" / "data")
    got = compress(spark, str(tmp_path / "d.d" / "data"), sample_rate=100.0, n_channels=10, dtype="int16", check_after_compress=False)
    assert got["out"] == str(tmp_path / "d.d" / "data.cbin") and got["sha1_uncompressed"] is None
    x[77, 3] ^= 1
    x.tofile(path)
    with pytest.raises(IntegrityError, match="1 samples differ"):
        own.verify_file(path, arrays.raw_layout(path, "int16", 10))


def test_digests_are_folded_off_the_driver(spark, tmp_path, monkeypatch):
    import hashlib

    x = full_range("int16", (2350, 4), seed=11)
    x.tofile(tmp_path / "x.bin")
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: pytest.fail("rows are brought to the driver"))
    figures = compress(spark, str(tmp_path / "x.bin"), sample_rate=100.0, n_channels=4, dtype="int16", chunk_duration=0.1)
    own = SignalStore.open_cbin(spark, figures["out"])
    own.check_file_digest()
    mixed = SignalStore(own.chunks.repartition(7, "payload"), own.meta)
    assert mixed.sha1_uncompressed() == figures["sha1_uncompressed"] == hashlib.sha1(x.tobytes()).hexdigest()
    assert mixed.sha1_compressed() == hashlib.sha1((tmp_path / "x.cbin").read_bytes()).hexdigest()
    assert SignalStore(own.chunks.limit(0), own.meta).sha1_compressed() == hashlib.sha1().hexdigest()


def test_raw_and_npy_sources(spark, tmp_path):
    x = full_range("int16", (30, 4))
    path = str(tmp_path / "r.bin")
    with open(path, "wb") as f:
        f.write(b"headerhd" + x.astype(">i2").tobytes())
    assert (back(arrays.load_raw(spark, path, ">i2", 4, offset=8), "int16") == x).all()
    with pytest.raises(ValueError):
        arrays.load_raw(spark, path, "int16", 7)
    with pytest.raises(FileNotFoundError):
        arrays.load_raw(spark, path + "x", "int16", 4)
    cube = full_range("int16", (5, 6, 4), seed=8)
    np.save(tmp_path / "cube.npy", cube)
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.save(tmp_path / "one.npy", x[0])
    with open(tmp_path / "v3.npy", "wb") as f:
        np.lib.format.write_array(f, x, version=(3, 0))
    assert (back(arrays.load_npy(spark, str(tmp_path / "v3.npy")), "int16") == x).all()
    assert (back(arrays.load_npy(spark, str(tmp_path / "f.npy")), "int16") == x).all()
    store = SignalStore.from_npy(spark, str(tmp_path / "cube.npy"), 10.0, do_time_diff=False)
    assert store.meta.shape == (5, 6, 4) and (back(store.decode(), "int16") == cube.reshape(-1, 4)).all()
    with pytest.raises(ValueError):
        arrays.load_npy(spark, str(tmp_path / "one.npy")).count()


def test_long_chunks_and_bad_signals(spark, tmp_path):
    long = spark.range(25000).select(F.col("id").alias("t"), F.array((F.col("id") % 1000).cast("smallint")).alias("samples"))
    store = SignalStore.encode(long, "int16", 25000.0)
    assert store.meta.n_chunks == 1 and store.violations(long).count() == 0
    one = SignalStore.encode(long.where("t = 0"), "int16", 10.0)
    assert one.shape == (1, 1) and one[0].count() == 1
    with pytest.raises(ValueError):
        SignalStore.encode(long.where("t < 0"), "int16", 10.0)
    # gaps within a chunk, at either end of one, and whole chunks
    for gap in ("t <> 5", "t not between 20 and 24", "t not between 0 and 2", "t not between 95 and 99"):
        with pytest.raises(Exception, match="missing or repeated"):
            SignalStore.encode(long.where("t < 1000").where(gap), "int16", 100.0).chunks.count()
    with pytest.raises(IntegrityError, match="has 9 chunks"):
        SignalStore.encode(long.where("t < 1000 and t not between 200 and 299"), "int16", 100.0).save(f"file://{tmp_path}/gap")
    with pytest.raises(IntegrityError, match="has 9 chunks"):
        SignalStore.encode(long.where("t < 1000 and t not between 200 and 299"), "int16", 100.0).write_cbin(str(tmp_path / "gap.cbin"))
    with pytest.raises(ValueError):
        dtypes.sample_type("bool")


def test_quantise(spark):
    values = np.random.default_rng(9).normal(0, 0.25, 500)
    peak = float(np.abs(values).max())
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "t bigint, v double")
    got = df.withColumn("q", dtypes.quantise(F.col("v"), peak)).withColumn("r", dtypes.dequantise(F.col("q"), peak)).orderBy("t").collect()
    assert [r.q for r in got] == (values / peak * 32766).astype("i2").tolist()
    assert max(abs(r.r - r.v) for r in got) < 1e-4
    assert df.select(dtypes.quantise(F.lit(0.0), 0.0)).first()[0] == 0


def test_config(tmp_path):
    assert CodecConfig.resolve(comp_level=None).comp_level == -1
    CodecConfig.store(chunk_duration=2.5, dtype="int16")
    assert CodecConfig.resolve().chunk_duration == 2.5 and CodecConfig.resolve(chunk_duration=0.5).chunk_duration == 0.5
    assert json.loads(CodecConfig.path().read_text()) == {"chunk_duration": 2.5, "dtype": "int16"}
    for bad in ({"algorithm": "lzma"}, {"chunk_order": "X"}, {"comp_level": 12}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            CodecConfig.resolve(**bad)


def test_command_line(spark, tmp_path, capsys):
    from tidegrid import cli

    x = full_range("int16", (300, 3))
    x.tofile(tmp_path / "a.bin")
    path = str(tmp_path / "a.bin")
    assert cli.run(["encode", path, "-d", "int16", "-s", "100", "-n", "3", "-c", "0.5", "--set-default"], spark) == 0
    assert json.loads((tmp_path / "a.ch").read_text())["chunk_bounds"] == [0, 50, 100, 150, 200, 250, 300]
    assert cli.run(["decode", str(tmp_path / "a.cbin"), "-o", str(tmp_path / "b.bin")], spark) == 0
    assert (tmp_path / "b.bin").read_bytes() == x.tobytes()
    capsys.readouterr()
    assert cli.run(["describe", str(tmp_path / "a.cbin")], spark) == 0
    assert "n_chunks        6" in capsys.readouterr().out
    assert cli.run(["chop", str(tmp_path / "a.cbin"), "-n", "2", "-o", str(tmp_path / "c.cbin")], spark) == 0
    assert json.loads((tmp_path / "c.ch").read_text())["chunk_bounds"] == [0, 50, 100]
    assert cli.run(["encode", path, "-f"], spark) == 0  # by the stored defaults
    assert cli.run(["decode", str(tmp_path / "none.cbin")], spark) == 1


def test_stream(spark, tmp_path):
    x = full_range("int16", (95, 3), seed=11)
    for k, part in enumerate(frame(spark, x).randomSplit([1.0, 1.0, 1.0], seed=3)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = frame(spark, x).schema
    chunks = encode_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "int16", 3, 10, n_samples=95)
    q = chunks.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    batch = SignalStore.encode(frame(spark, x), "int16", 10.0).chunks
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("chunk_idx", "sha1", "sha1_raw").exceptAll(batch.select("chunk_idx", "sha1", "sha1_raw")).count() == 0 and got.count() == 10


def test_ordered_sink_refuses_existing(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"x")
    with pytest.raises(FileExistsError):
        sinks.write_ordered(frame(spark, full_range("int16", (5, 1))), "t", "tidegrid_raw_sink", False, path=str(tmp_path / "f.bin"), dtype="int16")
