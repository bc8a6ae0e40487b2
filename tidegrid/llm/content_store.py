"""Content-addressed store of token ids (operator 5).

Layout of a store below one folder, all Parquet so that any store Spark reaches will do:

* ``chunks``: hash (16-byte BLAKE2b of the ids as little-endian unsigned 32-bit), n, data (the ids in
  ``width`` bytes each). Every distinct chunk is there once.
* ``recipes``: one row per document in ascending doc_id order (part, idx): start (ids of all documents
  before it), n_tokens, hashes, after (ids of the document behind each chunk) and root (SHA-256 of the
  hashes in order).
* ``manifest``: Merkle levels over the recipes' roots, 1024 children to a node; the single node of the
  highest level is the digest of the whole store.

A chunk ends where a rolling hash over the last 16 ids has nine given bits zero, so equal passages give equal
chunks wherever they stand. Reading checks each chunk against its hash, each recipe against its root and
the manifest against the recipes. The CRC-32 of a whole document follows from those of its chunks (a
CRC is linear over GF(2)), so verification moves some 40 bytes per chunk, never the ids.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm import tokens
from tidegrid.llm.shared import materialise, new_dir, release

WINDOW, LEAST, MOST, MASK = 16, 64, 4096, 511
NODE = 1024
#: Hashes that a task remembers, so that it stores equal chunks once.
MET = 100_000
#: Repeated chunks up to this number (eight bytes each) are broadcast to the write; more are dropped by a shuffle join.
BROADCAST_REPEATS = 500_000
END_ID = (0).to_bytes(4, "little")
#: Reflected CRC-32 polynomial (fixed value).
POLY = 0xEDB88320


class StoreError(ValueError):
    """A chunk, recipe or manifest does not match its digest."""


ODD = 0xD1342543DE82EF95
_held: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]


def _powers(n: int) -> list[np.ndarray]:
    """ODD**i and ODD**-i modulo 2**64 for i < n."""
    if len(_held[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            _held[k] = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(size - 1, base, "u8")]))
    return [p[:n] for p in _held]


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which a rolling hash over the last WINDOW ids has its low bits zero."""
    x = (ids.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    # the id k places back is weighted by ODD**k; as ODD has an inverse modulo 2**64, prefix sums give all windows
    up, down = _powers(len(ids))
    x *= down
    np.cumsum(x, out=x)
    x[WINDOW:] -= x[:-WINDOW].copy()
    x *= up
    return np.flatnonzero((x >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cut_places(marks: list[int], first: int, last: int) -> list[int]:
    """Ends of the chunks of the stream from ``first`` to ``last``; ``marks`` are the hash's places within it.

    No chunk but the last is shorter than LEAST, which exceeds WINDOW, so what stands before the stream has no effect.
    """
    out = []
    for p in marks:
        while p - first > MOST:
            first += MOST
            out.append(first)
        if p - first >= LEAST and p < last:
            first = p
            out.append(p)
    while last - first > MOST:
        first += MOST
        out.append(first)
    return [*out, last]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo POLY, in the bit order of CRC-32 (x**0 is the highest bit)."""
    a, b, out = a.copy(), b.copy(), np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(POLY), b >> np.uint32(1))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a CRC contributes to that of a longer string with n_bytes more behind it."""
    out, n = crc.astype("u4"), n_bytes.astype("u8")
    power = np.array([1 << 23], "u4")  # x**8: one byte
    while n.any():
        out = np.where(n & np.uint64(1), times(out, np.broadcast_to(power, out.shape)), out)
        power, n = times(power, power), n >> np.uint64(1)
    return out


def id_width(path: str) -> int:
    """Bytes that hold every id of a tokenizer file."""
    return 2 if tokens.tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _encoded(df: DataFrame, path: str, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows of kind r (a document's recipe) and c (a chunk that the task had not met lately), each with a number of its own."""
    source = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    id_type = source.schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("uid", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("hashes", T.ArrayType(T.BinaryType())), T.StructField("after", T.ArrayType(T.LongType())), T.StructField("root", T.BinaryType()), T.StructField("hash", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("kind", T.StringType())])

    def encode(batches):
        encoder, met = tokens.encoder(path, keep_space=True), set()
        uid = TaskContext.get().partitionId() << 36
        blake, sha = hashlib.blake2b, hashlib.sha256
        for batch in batches:
            arrow = pa.schema([("doc_id", batch.schema.field(0).type), ("uid", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.list_(pa.binary())), ("after", pa.list_(pa.int64())), ("root", pa.binary()), ("hash", pa.binary()), ("n", pa.int32()), ("data", pa.binary()), ("kind", pa.string())])
            for row, texts in tokens.text_slices(batch, 1, 1_000_000):
                each = [data + END_ID for data in encoder.encode(texts)]
                bounds = np.cumsum([0, *(len(x) // 4 for x in each)])
                data = b"".join(each)
                del each
                ids = np.frombuffer(data, "<u4")
                narrow, marks = ids.astype(f"<u{width}").tobytes(), cut_marks(ids)
                split = np.searchsorted(marks, bounds, side="right").tolist()
                marks, bounds = marks.tolist(), bounds.tolist()
                hashes, after, roots, chunks = [], [], [], []
                for k, (first, last) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    own, ends, a = [], cut_places(marks[split[k] : split[k + 1]], first, last), first
                    for b in ends:
                        own.append(h := blake(data[4 * a : 4 * b], digest_size=16).digest())
                        if h not in met:
                            if len(met) > MET:
                                met.clear()
                            met.add(h)
                            chunks.append((h, b - a, narrow[width * a : width * b]))
                        a = b
                    hashes.append(own)
                    after.append([last - b for b in ends])
                    roots.append(sha(b"".join(own)).digest())
                n = len(texts)
                nulls = lambda t, n: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.arange(uid, uid + n)), pa.array(np.diff(bounds)), pa.array(hashes, arrow.types[3]), pa.array(after, arrow.types[4]), pa.array(roots, pa.binary()), *(nulls(t, n) for t in arrow.types[6:9]), pa.array(["r"] * n)], schema=arrow)
                uid += n
                if m := len(chunks):
                    found = list(zip(*chunks, strict=True))
                    yield pa.RecordBatch.from_arrays([nulls(arrow.types[0], m), pa.array(np.arange(uid, uid + m)), *(nulls(t, m) for t in arrow.types[2:6]), *(pa.array(c, t) for c, t in zip(found, arrow.types[6:9], strict=True)), pa.array(["c"] * m)], schema=arrow)
                    uid += m

    return source.mapInArrow(encode, schema)


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """uid of each chunk whose hash a chunk of a lesser uid has too. Hashes and numbers are moved, never the ids."""
    first = chunks.groupBy("hash").agg(F.min("uid").alias("first"), F.count("*").alias("times")).where("times > 1").select("hash", "first")
    return chunks.select("hash", "uid").join(first, "hash").where("uid <> first").select("uid")


def write_store(df: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> None:
    """Encode all texts of ``df`` and write a store to ``folder``.

    ``path`` is a byte-level tokenizer file; ids take ``width`` bytes, by default as many as its vocabulary
    needs. Null and empty texts are the end id alone. Null ids sort first; rows with the same id follow each
    other. An empty table gives an empty store. Texts are encoded once, and each distinct chunk is kept where
    its first task wrote it: repeated ones are found by hash and number and left out of a second write, so
    a passage that a third of all documents share gathers in no task.
    """
    spark, width = df.sparkSession, width or id_width(path)
    raw = materialise(_encoded(df, path, id_col, text_col, width), "encoded", ("kind",))
    chunk = raw.where("kind = 'c'").select("uid", "hash", "n", "data")
    repeated = materialise(repeated_chunks(chunk), "repeated")
    gone = F.broadcast(repeated) if repeated.count() <= BROADCAST_REPEATS else repeated
    chunk.join(gone, "uid", "left_anti").select("hash", "n", "data", F.lit(width).alias("width")).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    release(repeated)
    recipes = raw.where("kind = 'r'").select("doc_id", "uid", "n_tokens", "hashes", "after", "root")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = recipes.repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first(), "uid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "uid")

    def number(batches):
        at = total = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            before = np.cumsum(n) - n + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(n), pa.int32()), pa.array(np.arange(at, at + len(n)), pa.int64()), pa.array(before, pa.int64())], schema=batch.schema.append(pa.field("part", pa.int32())).append(pa.field("at", pa.int64())).append(pa.field("before", pa.int64())))
            at, total = at + len(n), total + int(n.sum())

    placed = materialise(order.mapInArrow(number, T.StructType([*recipes.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("before", T.LongType())])), "placed")
    # one row per range partition: at most n_parts rows, so the window and the broadcast stay small
    rows, ids = placed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("ids")), "sum({}) over (order by part rows between unbounded preceding and 1 preceding)"
    base = rows.selectExpr("part", f"coalesce({ids.format('rows')}, 0) as row0", f"coalesce({ids.format('ids')}, 0) as id0")
    placed.join(F.broadcast(base), "part").selectExpr("part", "row0 + at as idx", "doc_id", "id0 + before as start", "n_tokens", "hashes", "after", "root").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    release(raw)
    release(placed)
    merkle(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def merkle(recipes: DataFrame) -> DataFrame:
    """level, idx, digest of all nodes over the recipes' roots."""
    level, number, levels = recipes.select("idx", F.col("root").alias("digest")), 1, []
    while True:
        level = level.groupBy(F.expr(f"idx div {NODE}").alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("of"))
        level = materialise(level.select("idx", F.unhex(F.sha2(F.unhex(F.array_join(F.transform("of", lambda x: F.hex(x["digest"])), "")), 256)).alias("digest")), "merkle")
        levels.append(level.select(F.lit(number).alias("level"), "idx", "digest"))
        number += 1
        if level.count() <= 1:
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def chunk_digests(spark: SparkSession, folder: str) -> DataFrame:
    """hash, n, crc of each stored chunk, checked against its hash."""

    def check(batches):
        for batch in batches:
            hashes, width = batch.column("hash").to_pylist(), batch.column("width").to_pylist()
            crc, count = [], []
            for h, w, data in zip(hashes, width, batch.column("data").to_pylist(), strict=True):
                ids = np.frombuffer(data, f"<u{w}").astype("<u4").tobytes()
                if hashlib.blake2b(ids, digest_size=16).digest() != h:
                    raise StoreError(f"chunk {h.hex()} does not match its hash")
                crc.append(zlib.crc32(ids))
                count.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(count, pa.int64()), pa.array(crc, pa.int64())], names=["hash", "n", "crc"])

    return spark.read.parquet(f"{folder}/chunks").mapInArrow(check, "hash binary, n bigint, crc bigint")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and n_chunks of each document, from the files and verified.

    Fails with an error if a chunk is missing or altered or a recipe does not match its root.
    """
    recipes = spark.read.parquet(f"{folder}/recipes")
    sound = F.sha2(F.unhex(F.array_join(F.transform("hashes", F.hex), "")), 256) == F.lower(F.hex("root"))
    recipes = recipes.select("idx", "doc_id", "start", "n_tokens", F.when(sound, F.col("hashes")).otherwise(F.raise_error(F.concat(F.lit("recipe does not match its root: "), F.col("idx").cast("string")))).alias("hashes"), "after")
    used = recipes.select("idx", "doc_id", "start", "n_tokens", F.size("hashes").alias("n_chunks"), F.explode(F.arrays_zip("hashes", "after")).alias("c"))
    used = used.select("idx", "doc_id", "start", "n_tokens", "n_chunks", F.col("c.hashes").alias("hash"), F.col("c.after").alias("after"))

    def terms(batches):
        for batch in batches:
            crc, after = batch.column("crc").to_numpy(), batch.column("after").to_numpy()
            term = shifted(crc, after * 4).astype("i8")
            keep = [c for c in batch.schema.names if c not in ("hash", "after", "crc")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(term, pa.int64())], names=[*keep, "term"])

    joined = used.join(chunk_digests(spark, folder), "hash")
    keep = [f for f in joined.schema.fields if f.name not in ("hash", "after", "crc")]
    one = joined.mapInArrow(terms, T.StructType([*keep, T.StructField("term", T.LongType())]))
    docs = one.groupBy("idx", "doc_id", "start", "n_tokens", "n_chunks").agg(F.bit_xor("term").alias("ids_crc32"), F.sum("n").alias("sum_n"), F.count("*").alias("met"))
    whole = (F.col("sum_n") == F.col("n_tokens")) & (F.col("met") == F.col("n_chunks"))
    return docs.select("doc_id", "start", "n_tokens", F.when(whole, F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("document does not add up: "), F.col("idx").cast("string")))).alias("ids_crc32"), "n_chunks", "idx")


def check_manifest(spark: SparkSession, folder: str) -> bytes | None:
    """The store's digest, after the manifest has been computed anew from the recipes; None if empty."""
    held, now = spark.read.parquet(f"{folder}/manifest"), merkle(spark.read.parquet(f"{folder}/recipes"))
    if not (held.exceptAll(now).isEmpty() and now.exceptAll(held).isEmpty()):
        raise StoreError("the manifest does not match the recipes")
    top = held.orderBy(F.desc("level")).select("digest").first()
    return bytes(top[0]) if top else None


def reconstruct(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> DataFrame:
    """idx, doc_id and ids (array) of all documents, or of those whose doc_id is in ``docs``."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    if docs is not None:
        recipes = recipes.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.parquet(f"{folder}/chunks")
    used = recipes.select("idx", "doc_id", F.posexplode("hashes").alias("pos", "hash")).join(chunks, "hash")
    docs = used.groupBy("idx", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "data"))).alias("parts"))

    def join(batches):
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["data"], f"<u{p['width']}").astype("i8") for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["idx", "doc_id", "ids"])

    return docs.mapInArrow(join, T.StructType([docs.schema["idx"], docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.LongType()))]))


def store_and_read(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store to the shared folder, check its manifest, and return read_digests() of it."""
    spark = df.sparkSession
    folder = new_dir(spark, "store")
    write_store(df, path, folder, id_col, text_col)
    check_manifest(spark, folder)
    return read_digests(spark, folder)
