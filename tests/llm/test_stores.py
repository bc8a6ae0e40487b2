import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard

from tidegrid.llm import content_store, tokens, warc
from tidegrid.llm.shared import new_dir, shared_root

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_content_store_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (None, ""), (-7, "again"), (-7, "again"), (10**6, "x y " * 9000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, hash string").repartition(3)
    folder = new_dir(spark, "test")
    content_store.write_store(df, BYTE, folder)
    assert len(content_store.check_manifest(spark, folder)) == 32
    got = sorted(content_store.read_digests(spark, folder).collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == list(range(len(rows)))
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at, lib = 0, tokens.tokenizer(BYTE)
    want = {}
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    ids = {r.idx: r.ids for r in content_store.reconstruct(spark, folder).collect()}
    assert all(zlib.crc32(np.array(ids[r.idx], "<u4").tobytes()) == r.ids_crc32 for r in got)
    some = content_store.reconstruct(spark, folder, spark.createDataFrame([(-7,)], "doc_id long")).collect()
    assert len(some) == 2 and some[0].ids == some[1].ids
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count() < sum(r.n_chunks for r in got)


def test_content_store_finds_damage(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 50) for i in range(20)], "doc_id long, text string")
    folder = new_dir(spark, "test")
    content_store.write_store(df, BYTE, folder)
    chunks = spark.read.parquet(f"{folder}/chunks")
    bad = new_dir(spark, "bad")
    chunks.selectExpr("hash", "n", "overlay(data placing x'0102' from 3) as data", "width").write.parquet(f"{bad}/chunks")
    spark.read.parquet(f"{folder}/recipes").write.parquet(f"{bad}/recipes")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="does not match its hash"):
        content_store.read_digests(spark, bad).collect()
    other = new_dir(spark, "bad")
    chunks.write.parquet(f"{other}/chunks")
    spark.read.parquet(f"{folder}/recipes").selectExpr("part", "idx", "doc_id", "start", "n_tokens", "reverse(concat(hashes, array(x'00'))) as hashes", "after", "root").write.parquet(f"{other}/recipes")
    with pytest.raises(Exception, match="does not match its root"):
        content_store.read_digests(spark, other).collect()
    less = new_dir(spark, "bad")
    spark.read.parquet(f"{folder}/recipes").where("idx <> 3").write.parquet(f"{less}/recipes")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{less}/manifest")
    with pytest.raises(content_store.StoreError):
        content_store.check_manifest(spark, less)


def test_content_store_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert content_store.store_and_read(df, BYTE).count() == 0


def cuts_of(ids):
    return content_store.cut_places(content_store.cut_marks(ids).tolist(), 0, len(ids))


def test_cut_places_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50000, 20000).astype("u4")
    cuts = cuts_of(a)
    assert cuts[-1] == len(a) and all(content_store.LEAST <= y - x <= content_store.MOST for x, y in zip([0, *cuts], cuts[:-1], strict=False))
    shifted = set(cuts_of(np.concatenate([a[:5], a])))
    assert len({c + 5 for c in cuts} & shifted) > 0.8 * len(cuts)
    assert cuts_of(np.zeros(10000, "u4"))[-1] == 10000


def test_cut_marks_are_those_of_the_rolling_hash():
    ids = np.random.default_rng(4).integers(0, 50000, 3000).astype("u4")
    mixed = [(int(i) + 1) * 0x9E3779B97F4A7C15 % 2**64 for i in ids]
    mixed = [x ^ (x >> 29) for x in mixed]
    want = [p for p in range(1, len(ids) + 1) if sum(mixed[p - 1 - k] * pow(content_store.ODD, k, 2**64) for k in range(min(p, content_store.WINDOW))) % 2**64 >> 40 & content_store.MASK == 0]
    assert content_store.cut_marks(ids).tolist() == want
    # in the middle of a longer stream a document has the same chunks
    both = np.concatenate([ids[::-1], ids])
    marks = [m for m in content_store.cut_marks(both).tolist() if m > 3000]
    assert [c - 3000 for c in content_store.cut_places(marks, 3000, 6000)] == cuts_of(ids)


def test_repeated_chunks_by_shuffle(spark, monkeypatch):
    """A chunk that most documents have, met by many tasks, without the broadcast."""
    monkeypatch.setattr(content_store, "BROADCAST_REPEATS", -1)
    shared = " ".join(f"word{i * 7919 % 1000}" for i in range(1500))
    df = spark.createDataFrame([(i, shared if i % 3 else f"{i} {shared}") for i in range(40)], "doc_id long, text string").repartition(8)
    folder = new_dir(spark, "test")
    content_store.write_store(df, BYTE, folder)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    lib = tokens.tokenizer(BYTE)
    want = {r.doc_id: zlib.crc32(np.array([*lib.encode(r.text).ids, 0], "<u4").tobytes()) for r in df.collect()}
    assert {r.doc_id: r.ids_crc32 for r in content_store.read_digests(spark, folder).collect()} == want
    assert content_store.id_width(BYTE) == 2


def test_crc_shift():
    rng = np.random.default_rng(2)
    for n in (0, 1, 4, 1000, 70000):
        a, b = rng.bytes(33), rng.bytes(n)
        got = content_store.shifted(np.array([zlib.crc32(a)], "u4"), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert got == zlib.crc32(a + b)


PAGES = [(5, "http://a/ü x", "same"), (3, "u3", "same"), (9, None, "same"), (None, "n", "same"), (1, "e", None), (2, "e2", ""), (4, "big", "<p>" * 40000), (3, "u3", "same"), (8, "l", "a\r\n\r\nb")]


def pages(spark):
    return spark.createDataFrame([(*r, "extra") for r in PAGES], "page_id long, url string, html string, refers_to string").repartition(2)


@pytest.mark.parametrize("dictionary", [True, False])
def test_warc_round_trip(spark, dictionary):
    folder = new_dir(spark, "warc")
    samples = [f"<html><body>page {i} {'text ' * (i % 7)}</body></html>".encode() for i in range(500)]
    data = zstandard.train_dictionary(2048, samples).as_bytes() if dictionary else None
    manifest = warc.write_archives(pages(spark), folder, 0, archive_bytes=300, dictionary=data)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    rows = warc.read_archives(spark, folder).collect()
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in rows), key=str)
    assert got == sorted([(5, "revisit", 3, 4, None), (3, "response", None, 4, "same"), (3, "response", None, 4, "same"), (9, "revisit", 3, 4, None), (-1, "revisit", 3, 4, None), (1, "response", None, 0, ""), (2, "revisit", 1, 0, None), (4, "response", None, 120000, "<p>" * 40000), (8, "response", None, 6, "a\r\n\r\nb")], key=str)
    assert {(r.page_id, r.refers_to) for r in rows if r.record_type == "revisit"} == {(5, 3), (9, 3), (None, 3), (2, 1)}
    assert all(r.payload_digest == warc.digest({p: (h or "").encode() for p, _, h in PAGES}[r.page_id]) for r in rows)


def test_warc_small_payloads_are_responses(spark):
    folder = new_dir(spark, "warc")
    warc.write_archives(pages(spark), folder, 5)
    assert warc.read_archives(spark, folder, False).where("record_type = 'revisit'").count() == 0


def test_warc_leftovers_of_other_attempts_go(spark):
    folder = new_dir(spark, "warc")
    with open(folder.removeprefix("file://") + "/part-000000-99-dead-0000.warc.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(warc.page_record(77, "u", b"x", None, "urn:x")))
    manifest = warc.write_archives(pages(spark), folder)
    assert warc.read_archives(spark, folder, False).where("page_id = 77").count() == 0
    assert shared_root(spark)
    with open(folder.removeprefix("file://") + "/part-000000-98-late-0000.warc.zst", "wb") as f:
        f.write(zstandard.ZstdCompressor().compress(warc.page_record(77, "u", b"x", None, "urn:x")))
    got = warc.read_archives(spark, folder, False, manifest)
    assert got.count() == len(PAGES) and got.where("page_id = 77").count() == 0
    with pytest.raises(Exception, match="the manifest says"):
        warc.read_archives(spark, folder, False, manifest.withColumn("records", manifest.records + 1)).collect()


def test_warc_empty(spark):
    assert warc.archive_and_read(pages(spark).limit(0)).count() == 0


def test_warc_rejects_malformed():
    good = warc.page_record(1, "u", b"payload", None, "urn:x")
    assert warc.page_of(warc.parse_record(good))["page_id"] == 1
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date", b"WARC-Dat"), good.replace(b"WARC-Type: ", b"WARC Type: "), good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    for bad in (good.replace(b"payload\r", b"paylaod\r"), good.replace(b"charset=utf-8\r\nContent-Length: 7", b"charset=utf-8\r\nContent-Length: 8")):
        with pytest.raises(warc.WarcError):
            warc.page_of(warc.parse_record(bad))
    press = zstandard.ZstdCompressor()
    archive = press.compress(good) + press.compress(good)
    assert list(warc.frames(archive)) == [good, good]
    for bad in (archive[:-5], archive + b"junk", struct.pack("<II", warc.DICT_MAGIC, 10**6) + archive):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    assert list(warc.frames(b"")) == []
