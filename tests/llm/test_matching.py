"""Operators on words and shingles against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import components, decontaminate, licenses, search, set_join

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORDS.findall((text or "").translate(FOLD))


# decontamination


def brute_leaks(docs, items, n):
    windows = [(i, w[k : k + n]) for i, w in items if w and i is not None for k in range(max(1, len(w) - n + 1))]
    out = []
    for d, w in docs:
        hit, found = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [4, 10])
def test_decontamination(spark, n):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(12)] + ["é", "ÉA", "x1"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 2, 3, n - 1, n, n + 5, 30]))) for i in range(25)] + [(99, None), (None, text(20)), (5, text(12))]
    docs = []
    for d in range(80):
        parts = [text(rng.randrange(0, 20))]
        for _ in range(rng.randrange(0, 4)):
            i, t = rng.choice(items)
            w = (t or "").split()
            a = rng.randrange(len(w) + 1)
            parts.append(", ".join(w[a : a + rng.randrange(1, 30)]).upper().replace("É", "é"))
        docs.append((d, "! ".join(parts)))
    docs += [(7, docs[7][1]), (500, None), (None, None), (None, docs[3][1]), (501, ""), (502, "?!"), (503, docs[5][1] * 300)]
    left = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, items int").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(left, right, n=n).drop("items").collect()), key=str)
    assert got == brute_leaks([(d, words(t)) for d, t in docs], [(i, words(t)) for i, t in items], n)
    assert decontaminate.decontaminate(left.limit(0), right, n=n).count() == 0
    assert decontaminate.decontaminate(left, right.limit(0), n=n).where("contaminated or n_items > 0").count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    left = spark.createDataFrame([(1, "a b c d e f"), (2, "x")], "doc_id long, text string")
    right = spark.createDataFrame([(1, "b c d e"), (2, "q r s")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(left, right, n=3).collect()}
    assert got == {1: (6, 4, ["1"]), 2: (1, 0, [])}


# Jaccard join


def brute_classes(rows, t, n):
    sets = {}
    for k, (_, x) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(FOLD))
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    distinct = {s for s in sets.values() if s}
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    by, order = {}, list(distinct)
    for i, s in enumerate(order):
        for j, m in Counter(j for g in s for j in by.get(g, ())).items():
            if Fraction(m, len(s) + len(order[j]) - m) >= t:
                root[find(s)] = find(order[j])
        for g in s:
            by.setdefault(g, []).append(i)
    least = {}
    for k, s in sets.items():
        if s and rows[k][0] is not None:
            least[find(s)] = min(least.get(find(s), rows[k][0]), rows[k][0])
    return sorted(((d, len(sets[k]), least.get(find(sets[k]), d) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=str)


def edited(rng):
    vocab, rows = [f"w{i}" for i in range(60)], []
    for size in (1, 2, 3, 4, 8, 11, 12, 13, 14, 20, 22, 25, 33, 45, 80, 150, 400):
        for few in (False, True):
            base = [rng.choice("abc" if few else vocab) for _ in range(size)]
            for _ in range(8):
                x = base[:]
                for _ in range(rng.randrange(0, 4)):
                    i = rng.randrange(len(x) + 1)
                    x[i : i + rng.randrange(2)] = [rng.choice("abcd" if few else vocab)] * rng.randrange(2)
                rows.append((len(rows), (" " if rng.random() < 0.5 else "\t").join(x).upper()))
    return rows


@pytest.mark.parametrize(("t", "n"), [("0.9", 3), ("0.8", 5), ("0.7", 2)])
def test_jaccard_components(spark, t, n):
    rows = edited(random.Random(n))
    rows += [(None, rows[40][1]), (None, "only here"), (None, None), (900, ""), (901, " \n"), (902, None), (5, rows[5][1]), (903, "long " * 20000), (904, "long " * 30000)]
    df = spark.createDataFrame([(d, x, 1) for d, x in rows], "doc_id long, text string, node int").repartition(3)
    got = sorted((tuple(r) for r in set_join.jaccard_components(df, t, n).collect()), key=str)
    assert got == brute_classes(rows, Fraction(t), n)


def test_jaccard_tiles_and_large_groups(spark, monkeypatch):
    """A group of many near copies, cut into tiles."""
    monkeypatch.setattr(set_join, "TILE_BYTES", 9000)
    monkeypatch.setattr(set_join, "STAR", 7)
    monkeypatch.setattr(set_join, "MET", 5)
    rng = random.Random(4)
    base = [f"v{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(150):
        x = base[:]
        for _ in range(rng.randrange(0, 3)):
            x[rng.randrange(60)] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in set_join.jaccard_components(df).collect()), key=str)
    assert got == brute_classes(rows, Fraction("0.9"), 3)
    assert set_join.jaccard_components(df.limit(0)).count() == 0


def test_entries_meet_for_all_similar_sets():
    """Every similar pair shares an index entry, for sets of all small sizes and segments of few elements."""
    rng = np.random.default_rng(6)
    for t in (Fraction("0.9"), Fraction("0.8"), Fraction("0.6")):
        bands = set_join.Bands(t)
        for size in [*range(2, 40), 63, 64, 65, 127, 128, 130, 300]:
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 63, size).astype("u8"))
                gone = rng.integers(0, bands.differ(len(a)) + 1)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone // 2 :]], rng.integers(0, 1 << 63, gone - gone // 2).astype("u8")]))
                both = len(np.intersect1d(a, b))
                if len(b) and set_join.similar(both, len(a), len(b), t) and both < max(len(a), len(b)):
                    assert len(np.intersect1d(set_join.entries(a, bands), set_join.entries(b, bands))), (t, len(a), len(b), both)


def test_shared_entries(spark, monkeypatch):
    monkeypatch.setattr(set_join, "PACKED", 500)  # many runs
    rng, bands, parts = random.Random(21), set_join.Bands(Fraction("0.8")), 300
    sets, base = [], [rng.getrandbits(64) for _ in range(60)]
    for _ in range(80):
        sets.append(sorted({*rng.sample(base, 55), *(rng.getrandbits(64) for _ in range(rng.randrange(4)))}))
    sets += [[rng.getrandbits(64) for _ in range(rng.randrange(1, 90))] for _ in range(80)]
    sets = [np.unique(np.array(s, "u8")) for s in sets]
    own = [set_join.entries(s, bands) for s in sets]
    times = Counter(np.concatenate(own).tolist())
    several = np.array([e for e, k in times.items() if k > 1], "u8")
    df = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "elements binary").repartition(3)
    got = [r.entry for r in set_join._shared_entries(df, bands, parts).collect()]
    assert max(times.values()) > 20 and len(set(got)) == len(got)
    assert set(got) == set(set_join.packed(several, parts).view("i8").tolist())
    assert set_join._shared_entries(df.limit(0), bands, parts).count() == 0
    assert set_join.repeated(np.array([3, 1, 3, 3, 2, 2], "u8"), 2).tolist() == [1, 2, 2, 3, 3]


def test_bounds_exclude_no_similar_pair():
    rng = np.random.default_rng(9)
    for t in (Fraction("0.9"), Fraction("0.8")):
        for size in (1, 2, 5, 9, 30, 100, 400):
            base = np.unique(rng.integers(0, 1 << 63, size).astype("u8"))
            sets = [np.unique(np.concatenate([base[rng.random(len(base)) > p], rng.integers(0, 1 << 63, k).astype("u8")])) for p in (0, 0.02, 0.05, 0.1) for k in (0, 1, size // 20, size // 8)]
            sets = [s for s in sets if len(s)]
            marks, sizes = [set_join.sketch(s) for s in sets], np.array([len(s) for s in sets])
            limit = set_join.difference_limits(2 * max(sizes), t)
            rows, near = set_join.folded(marks), {i for i in range(len(sets)) for j in range(len(sets)) if i != j and set_join.similar(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], t)}
            for i in range(1, len(sets)):
                may = set_join.may_be_similar(rows, i, sizes, limit)
                assert all(may[j] for j in range(i) if set_join.similar(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], t))
                assert all(set_join.common(sets[i], sets[j]) == len(np.intersect1d(sets[i], sets[j])) for j in range(i))
            where = {k: c for c, cluster in enumerate(set_join.suspects(marks, sizes, t, list(range(len(sets))))) for k in cluster.tolist()}
            assert near <= where.keys()
            assert all(where[i] == where[j] for i in near for j in near if i != j and set_join.similar(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j], t))


def test_hashes_equal_sparks(spark):
    from pyspark.sql import functions as F

    from tidegrid.llm import shared

    values = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 500)
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    assert [r[0] for r in df.select(F.xxhash64("v")).collect()] == shared.xxh64_of_longs(values).view("i8").tolist()
    table = shared.bit_table(df, "v")
    assert shared.hits(table, values).all() and shared.hits(table, values + 1).sum() < 5


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a)
        root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    joined = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in joined}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks_do_not_repeat_sets(spark, monkeypatch):
    rng, rows = random.Random(4), {}
    common = [f"w{i}" for i in range(40)]
    docs = []
    for d in range(160):  # alike, but few of them similar
        own = list(common)
        for at in rng.sample(range(40), 5):
            own[at] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join(own if d % 40 else common)))
    before = set_join.materialise

    def counted(df, label, *rest):
        out = before(df, label, *rest)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(set_join, "materialise", counted)
    monkeypatch.setattr(set_join, "TILE_BYTES", 32 * 3000)
    got = {r.doc_id: r.component_id for r in set_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), threshold="0.7", n=1).collect()}
    sets, want = [set(t.split()) for _, t in docs], list(range(160))
    for i in range(160):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j]) and want[i] != want[j]:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert got == dict(enumerate(want))
    assert rows.get("left") and rows["dealt"][0] == rows["left"][0]


# search


def brute_top(docs, queries, k):
    own = [(d, Counter(words(t))) for d, t in docs]
    n, mean = len(own), sum(sum(c.values()) for _, c in own) / len(own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for q, t in queries:
        if q is None:
            continue
        found = []
        for d, c in own:
            size = sum(c.values())
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in set(words(t)) if w in c)
            if s > 0:
                found.append((-round(s, 6), d is not None, d or 0))
        out += [(q, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k], 1)]
    return out


def test_search(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 50)
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "FIRST", 2)
    monkeypatch.setattr(search, "QUERY_TERMS", 500)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, docs[20][1]), (9001, None), (9002, ""), (9003, docs[0][1]), (9004, "word " * 30000)]
    queries = [(d, t) for d, t in docs if d is not None and d % 20 == 0][:6] + [(-1, "the of"), (-2, ""), (-3, None), (-4, "unheardof"), (None, "the")]
    left = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, score double").repartition(2)
    right = spark.createDataFrame(queries, "doc_id long, text string")
    got = sorted((tuple(r) for r in search.top_k(left, right, k=10).collect()), key=lambda r: r[:2])
    want = sorted(brute_top(docs, queries, 10), key=lambda r: r[:2])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert search.top_k(left.limit(0), right).count() == 0


def test_equal_texts_are_scored_once(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 9)
    monkeypatch.setattr(search, "QUERY_TERMS", 40)
    rng, asked = random.Random(12), []
    plain = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 12))) for _ in range(30)]
    docs = [(i, plain[i % 30]) for i in range(180)] + [(None, plain[3]), (None, plain[3]), (7, plain[3]), (900, ""), (901, ""), (902, None)]
    rng.shuffle(docs)
    queries = [(i, plain[i % 30]) for i in range(0, 180, 4)] + [(500, plain[1].upper() + "!"), (501, ""), (501, plain[2])]
    monkeypatch.setattr(search, "_common", lambda asking, n, own=search._common: asked.append(len(asking)) or own(asking, n))
    left, right = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (docs, queries))
    got = sorted((tuple(r) for r in search.top_k(left, right, k=8).collect()), key=lambda r: r[:2])
    want = sorted(brute_top(docs, [(q, t) for q, t in queries if t], 8), key=lambda r: r[:2])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert sum(asked) == len({frozenset(words(t)) for _, t in queries if t})
    index = search.build_index(left, 8).collect()
    assert sum(len(r.ids) for r in index) <= 32 and sum(sum(r.copies) for r in index) == len(docs)
    every = [[x, *more] for r in index for x, more in zip(r.ids, r.others, strict=True)]
    assert max(map(len, every)) == 8 and [None, None, 3, 7, 33, 63, 93, 123] in every


def test_pruning_skips_postings():
    rng = random.Random(2)
    docs = [Counter({rng.randrange(50): 1 for _ in range(20)}) for _ in range(2000)]
    for d in docs[640:660]:
        d.update({10**6: 5, 10**6 + 1: 5})
    shard = search.Shard([(np.array(list(d), "u8"), np.array(list(d.values()), "f4")) for d in docs], 20.0)
    wanted, idf = np.array([10**6, 10**6 + 1, 3, 4], "u8"), np.array([5.0, 5.0, 0.1, 0.1])
    found, scores, scored = shard.search(wanted, idf, 5, 0.0)
    everything = sum(sum(t in d for t in wanted.tolist()) for d in docs)
    assert scored < everything / 4 and set(found[np.argsort(-scores)[:5]]) <= set(range(640, 660))


def test_survivors_of_many_queries_are_scored_at_once(monkeypatch):
    rng = random.Random(9)
    docs = [Counter(rng.randrange(200) for _ in range(rng.randrange(0, 50))) for _ in range(500)]
    shard = search.Shard([(np.array(list(d), "u8"), np.array(list(d.values()), "f4")) for d in docs], 25.0)
    asked = [(np.array(list(d) + [10**6], "u8"), np.array([1.0 + t / 99 for t in d] + [9.0])) for d in docs[:90]]
    common, gathered, before = np.arange(20, dtype="u8"), [], search._ranges
    split = [search._split(t, w, common) for t, w in asked]
    terms = np.unique(np.concatenate([x[2] for x in split]))
    many = [(c, w, np.searchsorted(terms, t), i) for c, w, t, i in split]
    monkeypatch.setattr(search, "_ranges", lambda lo, hi: gathered.append(len(lo)) or before(lo, hi))
    part = lambda d, t: d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / 25.0))
    for most in (1 << 16, 100, 1):  # all at once, some, one query's at a time
        monkeypatch.setattr(search, "EXACT", most)
        dense, places = search.Dense(shard, common), shard.places(terms)
        gathered.clear()
        found = list(shard.search_many(many, places, 5, np.zeros(len(many)), dense))
        assert most < 1 << 16 or len(gathered) <= -(-len(many) // search.GATHER) + 1
        for (ids, scores, _), (t, w) in zip(found, asked, strict=True):
            want = np.array([sum(i * part(d, x) for x, i in zip(t.tolist(), w.tolist(), strict=True) if x in d) for d in docs])
            assert np.allclose(want[ids], scores, rtol=0, atol=1e-9)
            assert len(t) == 1 or set(np.flatnonzero(want >= np.sort(want)[-5])) <= set(ids.tolist())
    assert not shard.weight.any()


def test_search_many_against_all_scores():
    rng = random.Random(8)
    docs = [Counter(min(int(rng.paretovariate(0.6)), 3000) for _ in range(rng.randrange(1, 60))) for _ in range(700)]
    shard = search.Shard([(np.array(list(d), "u8"), np.array(list(d.values()), "f4")) for d in docs], 30.0)
    idf = {t: math.log(1 + 700 / sum(t in d for d in docs)) for t in {t for d in docs for t in d}}
    part = lambda d, t: d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / 30.0))
    asked = [(np.array(list(d), "u8"), np.array([idf[t] for t in d])) for d in docs[::20]]
    for common in (np.zeros(0, "u8"), np.array(range(1, 9), "u8"), np.array(sorted(idf), "u8")):
        split = [search._split(t, w, common) for t, w in asked]
        terms = np.unique(np.concatenate([x[2] for x in split]))
        many = [(c, w, np.searchsorted(terms, t), i) for c, w, t, i in split]
        floors = np.zeros(len(many))
        for _ in range(2):  # without floors, then with the tightest
            found = list(shard.search_many(many, shard.places(terms), 5, floors, search.Dense(shard, common)))
            for (ids, scores, _), (t, w) in zip(found, asked, strict=True):
                want = np.array([sum(i * part(d, x) for x, i in zip(t.tolist(), w.tolist(), strict=True) if x in d) for d in docs])
                assert np.allclose(want[ids], scores, rtol=0, atol=1e-9)
                assert set(np.flatnonzero(want >= np.sort(want)[-5])) <= set(ids.tolist())
            floors = np.array([np.sort(scores)[-5] for _, scores, _ in found])


def test_blocks_of_unlike_documents_are_dropped(spark):
    rng = random.Random(3)
    docs = [(d, " ".join(f"{'ab'[d % 2]}{rng.randrange(40)}" for _ in range(30))) for d in range(1024)]
    row = search.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).first()
    shard = search.Shard.load(row["index"], 30.0)
    wanted = search.terms(docs[0][1])[0]
    found, scores, scored = shard.search(wanted, np.ones(len(wanted)), 5, 0.0)
    again, same, less = shard.search(wanted, np.ones(len(wanted)), 5, np.sort(scores)[-5])
    assert sorted(row["ids"]) == list(range(1024)) and {row["ids"][d] % 2 for d in found} == {0}
    assert set(found) == set(again) and sorted(scores) == sorted(same) and less <= 640 * len(wanted)


def test_shards_reach_a_worker_one_by_one(spark):
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    with search._one_by_one(spark):
        rows = spark.range(40).coalesce(2).mapInArrow(sizes, "n bigint").collect()
    assert [r.n for r in rows] == [1] * 40 and spark.conf.get(name) == before


# licenses


def brute_licenses(docs, notices, share):
    own = []
    for name, t in notices:
        w = words(t)
        if w:
            c = max(8, 2 ** math.ceil(math.log2(len(w))))
            own.append((name, c, {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}))
    out = []
    for d, t in docs:
        w, found = words(t), set()
        grams = [(i, " ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))] if w else []
        for name, c, g in own:
            cells = {}
            for i, x in grams:
                if x in g:
                    for k in (0, 1):
                        cells.setdefault(i // c - k, set()).add(x)
            if any(len(x) / len(g) >= share for x in cells.values()):
                found.add(name)
        out.append((d, len(found), ",".join(sorted(found))))
    return sorted(out, key=str)


def test_licenses(spark):
    rng = random.Random(5)
    filler = lambda k: " ".join(rng.choice("lorem ipsum dolor sit the license under version".split()) for _ in range(k))
    docs = []
    for d in range(60):
        parts = [filler(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(licenses.TEMPLATES)[1].split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w), filler(rng.randrange(10))]
        docs.append((d, "\n".join(parts)))
    docs += [(3, docs[3][1]), (None, licenses.TEMPLATES[4][1]), (None, None), (71, ""), (72, "mit license"), (73, (docs[5][1] + "\n") * 200)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, matches string").repartition(3)
    got = sorted((tuple(r)[:3] for r in licenses.scan(df).collect()), key=str)
    assert got == brute_licenses(docs, licenses.TEMPLATES, 0.8)
    assert licenses.scan(df.limit(0)).count() == 0
    own = spark.createDataFrame([("tiny", "mit license"), (None, "x y z"), ("none", None)], "license_id string, text string")
    assert {r.doc_id for r in licenses.scan(df, own).where("n_licenses > 0").collect()} == {72}
    assert licenses.scan(df, own.limit(0)).where("n_licenses > 0").count() == 0
    spot = licenses.scan(df.where("doc_id is null and text is not null")).first().matches[0]
    assert (spot.license_id, spot.share, spot["first"]) == ("CC-BY-NC-4.0", 1.0, 0)
