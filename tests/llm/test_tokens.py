import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidegrid.llm import packing, quality, shared, token_counts, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    "  ",
    "I'll we're  don't 've x<|endoftext|>y '<|endof  \n\n  a\xa0\n b\x1c c \t\t'rex",
    "<|endoftext|><|startoftext|> <|endoftext|>",
    "日本語テキスト 12345 ²³ é́ 😀😀 ΣΑΣ ẞſ İ",
    "a" * 300,
    "!!'re 're'll'd",
    "One two, three. Four\nfive \nsix\n seven's eight) nine;) \ttab end ",
    " lead ünd ÉTÉ, x1, 12, 日本, a\x1cb \x1c c <|endoftext|>, d",
]


def mixed(n, seed):
    rng = random.Random(seed)
    parts = ["'", "s", "re", "ll", " ", "\n", "  ", "a", "B", "é", "1", "!!", "<|endoftext|>", "\xa0", "　", "\x1f", "th", "ing", "-", "Σ", "Ž"]
    return ["".join(rng.choice(parts) for _ in range(14)) for _ in range(n)]


@pytest.mark.parametrize(("path", "keep"), [(BYTE, True), (WORD, False)])
def test_encoder_equals_library(path, keep, spark, sf_dir):
    texts = ODD + mixed(300, 1) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    whole = tokens.tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)
    for _ in range(2):  # the second time from the cache
        got = tokens.encoder(path, keep).encode(texts)
        assert got == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 20)
    own = tokens.UnitEncoder(WORD, False)
    texts = [" ".join(f"w{i}" for i in range(k, k + 15)) for k in range(40)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer(WORD).encode_batch_fast(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and len(own.units) + len(own.units.old) <= 20


def remembered(own: tokens.UnitEncoder) -> int:
    return sum(len(x) for x in vars(own).values() if isinstance(x, dict))


def test_marks_and_line_ends_make_no_new_units():
    names = [f"{a}{b}" for a in ("alpha", "Béta", "gam") for b in ("ton", "ring", "x", "os", "ma", "ñu")]
    texts = [f"{a}.\n{b}, {a}&&& it's 12" for a in names for b in names]
    own = tokens.UnitEncoder(BYTE, True)
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer(BYTE).encode_batch_fast(texts, add_special_tokens=False)]
    assert remembered(own) <= 2 * len(names) + 10


def test_joined_words_make_no_new_units():
    names = [f"{a}{b}" for a in ("alpha", "Béta", "gam") for b in ("ton", "ring", "x", "os", "ma", "ñu")]
    texts = [f"{a}-{b} {b}'s ({a})." for a in names for b in names]
    own = tokens.UnitEncoder(WORD, False)
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tokens.tokenizer(WORD).encode_batch_fast(texts, add_special_tokens=False)]
    assert remembered(own) <= len(names) + 10


def test_prefix_table_equals_library_at_every_prefix():
    own, lib = token_counts.counter(BYTE), tokens.tokenizer(BYTE)
    for text in ODD + mixed(120, 2):
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert token_counts.prefix_counts(own.table(text)).tolist() == want, text
        for budget in (0, 3, 10):
            fits = [k for k, n in enumerate(want) if n <= budget]
            assert token_counts.longest_within(own.table(text), budget) == fits[-1]


def test_token_counts_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "", ""), (3, "word " * 3000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.token_counts(df, BYTE, limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars").collect()), key=str)
    lib = tokens.tokenizer(BYTE)
    want = []
    for i, t, _ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        fits = max(k for k in ([len(t or "")] if n <= 1024 else range(5000, 5200)) if len(lib.encode((t or "")[:k], add_special_tokens=False).ids) <= 1024)
        want.append((i, len((t or "").encode()), n, n > 1024, fits))
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0), BYTE).count() == 0


def check_packing(rows, texts, capacity):
    """All pieces are there, within capacity, gapless, and only long documents are cut."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = {}
    for (i, _), found in zip(texts, tokens.tokenizer(WORD).encode_batch_fast([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        data = np.array([*found.ids, 0], "<u4").tobytes()
        want.setdefault(i, []).extend((n, a, min(capacity, len(data) // 4 - a), zlib.crc32(data[4 * a : 4 * (a + capacity)])) for n, a in enumerate(range(0, len(data) // 4, capacity)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_seq)


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, "x"), (-1, ""), (-1, ""), (-2, "again " * 5000)], "doc_id long, text string")
    both = docs.unionByName(odd).withColumnsRenamed({}).selectExpr("*", "1 as length", "2 as uid").repartition(3)
    rows = packing.pack(both, WORD, 2048, block_items=64).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in both.collect()], 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 4  # a bin of slack for each of the blocks
    assert packing.pack(docs.limit(0), WORD).count() == 0
    only_long = spark.createDataFrame([(1, "a " * 2047)], "doc_id long, text string")
    assert [tuple(r)[1:5] for r in packing.pack(only_long, WORD).collect()][0][2] == 2048


def test_genetic_operators():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 100) for _ in range(200)]
    block = packing.Block(lengths, 100, rng)
    a, b = block.seed(0.0), block.seed(0.5)
    for child in (block.cross(a, b), block.mutate(a), block.mutate(block.cross(b, a))):
        assert sorted(i for m in child for i in m) == list(range(200)) and all(block.fill(m) <= 100 for m in child)
    first = block.cost(a)
    assert block.cost(block.evolve([a], 8, 4)[0]) <= first
    # a case in which longest-first best fit takes a bin more than needed
    hard = packing.Block([4, 4, 5, 3, 5, 3, 2, 2, 2], 10, random.Random(1))
    assert len(hard.evolve([hard.seed(0.0)], 30, 6)[0]) == 3


def test_evolution_over_islands(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(300, 700)) for i in range(300)]
    items = spark.createDataFrame(rows, "uid long, length long")
    got = packing.pack_items(items, 1000, 3, islands=3, epochs=3, generations=3).collect()
    assert sorted(r.uid for r in got) == list(range(300))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1000
    single = packing.pack_items(items, 1000, 3, islands=1, epochs=1, generations=0).select("sequence_id").distinct().count()
    assert len(fill) <= single


def test_packing_places_items_without_copies_of_blocks(spark):
    rng = random.Random(6)
    lengths = [rng.randrange(1, 60) for _ in range(300)]
    items = spark.createDataFrame([(i, None if i % 7 == 0 else f"d{i}", n) for i, n in enumerate(lengths)], "uid long, doc_id string, length long")
    out = packing.pack_items(items, 100, 3)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    rows, bins = out.collect(), {}
    assert sorted((r.uid, r.doc_id, r.length) for r in rows) == [(i, None if i % 7 == 0 else f"d{i}", n) for i, n in enumerate(lengths)]
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 100


def test_caches_of_other_steps_are_dropped():
    quality.word_buckets(["a", "word"])
    own = tokens.encoder(WORD, False)
    own.encode(["a word"])
    shared.drop_caches(tokens.CACHES)
    assert not quality._buckets and tokens.encoder(WORD, False) is own
    shared.drop_caches()
    assert not tokens._encoders and not tokens._loaded
    assert tokens.encoder(WORD, False).encode(["a word"]) == own.encode(["a word"])
