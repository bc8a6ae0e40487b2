"""WARC archives in Zstandard (operator 4): writer with revisit records, and a validating reader.

An archive is a skippable frame that holds the dictionary, then one frame per record. Archives are written
by the tasks under names of their own attempt; the names that the successful attempts return are the
manifest. What was written is read by it, file by file: a file that it doesn't name, even one that a slower attempt
of a task finishes later, is not read, so a lost executor or a repeated task neither loses nor doubles a record.
Folders of archives from elsewhere, which have no manifest, are read with Spark's binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.shared import materialise, new_dir, remove

#: The magic number of the skippable frame that holds the dictionary, and of Zstandard frames.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisits up to this number are joined by broadcast (some 40 bytes each), more by shuffle.
BROADCAST_ROWS = 100_000
FEED = 1 << 18
#: Archives that one task reads, where there are more than a few for each core.
READ_ARCHIVES = 8


class WarcError(ValueError):
    """An archive or a record in it is malformed."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, block: bytes, headers: dict[str, str | None]) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "1970-01-01T00:00:00Z", **headers, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, unnamed: str) -> bytes:
    """A response record, or a revisit of refers_to that has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = None if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))
    own = unnamed if page_id is None else f"urn:x-page:{page_id}"
    headers = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is None:
        return record("response", own, http + payload, headers)
    return record("revisit", own, http, headers | {"WARC-Refers-To": f"<urn:x-page:{refers_to}>", "WARC-Profile": PROFILE})


def parse_record(data: bytes) -> dict:
    """Headers (names in lower case) and block of one record; checks version, names, lengths and end."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise WarcError("a record does not begin with a WARC version line and headers")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"malformed header line {line[:80]!r}")
        headers[name.decode().lower()] = value.strip().decode("utf-8", "strict")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise WarcError(f"headers are missing: {sorted(missing)}")
    if not headers["content-length"].isdecimal():
        raise WarcError("Content-Length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length says {n} bytes; the record has {len(rest) - 4}")
    return {"headers": headers, "block": rest[:n]}


def page_of(rec: dict) -> dict | None:
    """What a response or revisit record says of its page, checked; None for other records."""
    h = rec["headers"]
    if h["warc-type"] not in ("response", "revisit"):
        return None
    head, found, payload = rec["block"].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
    if not found or not length:
        raise WarcError("an HTTP block has no header or no Content-Length")
    page = re.fullmatch(r"<urn:x-page:(-?\d+)>", h["warc-record-id"])
    refers = re.fullmatch(r"<urn:x-page:(-?\d+)>", h.get("warc-refers-to", ""))
    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response":
        if int(length[1]) != len(payload):
            raise WarcError(f"HTTP Content-Length says {int(length[1])} bytes; the payload has {len(payload)}")
        if digest(payload) != said:
            raise WarcError("a payload does not match its digest")
    elif payload or not refers:
        raise WarcError("a revisit has a payload or refers to nothing")
    return {"page_id": int(page[1]) if page else None, "url": h.get("warc-target-uri"), "payload_bytes": int(length[1]), "payload_digest": said, "record_type": h["warc-type"], "refers_to": int(refers[1]) if refers else None, "payload": payload if h["warc-type"] == "response" else None}


def frames(data: bytes):
    """The decoded frames of an archive, one after another; the dictionary comes from a leading skippable frame."""
    at, dictionary, view = 0, None, memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        if 8 + n > len(data):
            raise WarcError("the dictionary frame is cut off")
        content, at = data[8 : 8 + n], 8 + n
        if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    plain = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        if data[at : at + 4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError(f"no frame begins at byte {at}")
        one, out = plain.decompressobj(), []
        while not one.eof:
            part = view[at : at + FEED]
            if not part:
                raise WarcError("the last frame is cut off")
            try:
                out.append(one.decompress(part))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def dictionary_frame(dictionary: bytes | None) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def train_dictionary(pages: DataFrame, samples: int = 512, sample_chars: int = 8192, size: int = 32768) -> bytes | None:
    """A dictionary from at most ``samples`` pages (chosen by a hash) of at most ``sample_chars`` characters each.

    It affects the size of archives alone. None where the sample is too small to train on.
    """
    keyed = pages.where("html <> ''").withColumn("h", F.xxhash64("page_id", "url"))
    last = keyed.select("h").orderBy("h").limit(samples).agg(F.max("h")).first()[0]
    if last is None:
        return None
    rows = keyed.where(F.col("h") <= last).groupBy("h").agg(F.min(F.substring("html", 1, sample_chars)).alias("t")).orderBy("h").collect()
    try:
        return zstandard.train_dictionary(size, [r.t.encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def _target(uri: str):
    """(pyarrow file system, path) of a URI; file: URIs need no scheme handler."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file" or "/" in scheme:
        return fs.LocalFileSystem(), "/" + (rest if scheme == "file" else uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = 16 << 20, dictionary: bytes | None = None) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in ``folder``; returns the manifest.

    Of the rows whose payloads are equal and have at least ``min_revisit_bytes`` bytes, those with the
    smallest page_id are response records and the others revisit that page; smaller payloads are always
    responses. A null html is an empty payload; a null url leaves out WARC-Target-URI; a row without
    page_id is never the page that others refer to. Rows with the smallest page_id that repeat are all
    responses. Equality of payloads is that of SHA-1 and length. An empty table gives no archive.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.select("*", F.sha1("html").alias("sha"), F.octet_length("html").alias("n"))
    small = keyed.select("page_id", "sha", "n").where(F.col("n") >= min_revisit_bytes)
    firsts = materialise(small.groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").select("sha", "n", "first"), "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    # a payload that a third of all pages share makes one large key on the left, which an adaptive join splits
    placed = keyed.join(firsts, ["sha", "n"], "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        task = TaskContext.get()
        prefix = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        system, base = _target(folder)
        out, done, unnamed = None, [], 0

        def close():
            out[1].close()
            done.append((out[0], out[2], out[3]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{prefix}-{len(done):04d}.warc.zst"
                    out = [name, system.open_output_stream(f"{base}/{name}", compression=None), 0, 0]
                    out[1].write(dictionary_frame(dictionary) + press.compress(record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", b"format: WARC File Format 1.1\r\n", {"Content-Type": "application/warc-fields"})))
                unnamed += row["page_id"] is None
                data = press.compress(page_record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{prefix} {unnamed}')}"))
                out[1].write(data)
                out[2], out[3] = out[2] + 1, out[3] + len(data)
                if out[3] >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            name, n, size = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=["name", "records", "bytes"])

    manifest = materialise(placed.mapInArrow(write, "name string, records bigint, bytes bigint"), "manifest")
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    for r in there.join(manifest, "name", "left_anti").toLocalIterator():  # of attempts that failed
        remove(spark, f"{folder}/{r.name}")
    return manifest


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of each page record.

    Each archive is decoded frame by frame, one record to a frame. A malformed frame, header or length, or
    a payload that does not match its digest, fails with WarcError. With ``manifest`` (of write_archives()) the
    files that it names are read, and no others; one that is missing, or has another number of records, fails.
    """
    fields = [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())]
    arrow = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    if payloads:
        fields.append(T.StructField("payload", T.BinaryType()))
        arrow.append(("payload", pa.binary()))
    arrow = pa.schema(arrow)

    def pages_of(archive: bytes, expected: int | None = None):
        rows, size, n = [], 0, 0
        for data in frames(archive):
            if (page := page_of(parse_record(data))) is not None:
                if not payloads:
                    page.pop("payload")
                rows.append(page)
                n, size = n + 1, size + len(data)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        if expected is not None and n != expected:
            raise WarcError(f"the manifest says {expected} records; the archive has {n}")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from pages_of(batch.column(0)[i].as_py())

    def parse_named(batches):
        system, base = _target(folder)
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{base}/{name}", compression=None) as f:
                    archive = f.read()
                yield from pages_of(archive, n)

    if manifest is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
        return files.mapInArrow(parse, T.StructType(fields))
    n = manifest.count()
    tasks = max(-(-n // READ_ARCHIVES), min(n, 2 * spark.sparkContext.defaultParallelism), 1)
    return manifest.select("name", "records").repartition(tasks).mapInArrow(parse_named, T.StructType(fields))


def archive_and_read(pages: DataFrame, min_revisit_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what read_archives() finds in them."""
    spark = pages.sparkSession
    folder = new_dir(spark, "warc")
    manifest = write_archives(pages, folder, min_revisit_bytes, dictionary=train_dictionary(pages))
    return read_archives(spark, folder, payloads, manifest)
