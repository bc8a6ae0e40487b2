"""Classifier, chat formats, pipeline and the driver's entry."""

import hashlib
import zlib

import numpy as np
import pytest

from tidegrid.llm import chat, quality


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    rows = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == 1000 and sum(p == q for p, q in rows) / len(rows) > 0.95
    clean = [p for p, q in rows if q == 1]
    assert sum(clean) / len(clean) > 0.97


def test_quality_learns_nothing_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "good words here. " * 9 if i % 2 else "BAD!! " * 20) for i in range(300)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(300)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    a, b = (quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int"), sample=100) for x in (labels, flipped))
    assert (a.w == b.w).all() and (a.v == b.v).all() and a.w0 == b.w0


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "x", "c"), (2, "x", "c"), (3, "word " * 50000, "d"), (4, "\n\n", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none).count() == 0
    twice = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 1, 2, 3, 4)] + [(2, 1)], "doc_id long, quality int")
    assert quality.classify(docs, twice).count() == 6
    with pytest.raises(ValueError, match="choose another name"):
        quality.score(docs, quality.fit(docs, none), name="score")
    kept = quality.score(docs, quality.fit(docs, none))
    assert kept.columns == ["doc_id", "text", "score", "quality_score"] and kept.count() == 6


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = quality.Model(np.sort(rng.normal(size=(16, quality.BINS - 1))), 0.3, rng.normal(size=quality.BUCKETS + 16 * quality.BINS).astype("f4"), rng.normal(size=(quality.BUCKETS + 16 * quality.BINS, quality.FACTORS)).astype("f4"))
    found = [quality.features("some words, and some MORE!\nlines"), quality.features("")]
    ids, values, first = model.rows(found)
    for k, (a, b) in enumerate(zip(first, [*first[1:], len(ids)], strict=True)):
        x, i = values[a:b].astype("f8"), ids[a:b]
        z = model.w0 + (model.w[i] * x).sum() + sum((model.v[i[p]] * model.v[i[q]]).sum() * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert model.scores(found)[k] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-3)


ROWS = [(1, 0, "user", "a<|im_end|>\n<|im_start|>x"), (1, 1, "assistant", "&lt;[INST] é\n"), (2, None, None, None), (3, 1, "assistant", "b"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (4, 0, "rôle\nx&", ""), (None, 0, "assistant", "n"), (5, 0, "human", "h"), (6, 0, "user", None), (6, 1, "assistant", "z" * 100000), (3, 0, "user", "q")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, record int").repartition(3)
    got = {r.conv_id: r for r in chat.read_digests(chat.format_conversations(df)).collect()}
    by = {}
    for c, *r in ROWS:
        by.setdefault(c, []).append(r)
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort(key=lambda r: [(x is not None, x or "") if i else (x is not None, x or 0) for i, x in enumerate(r)])
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    own = chat.format_turns(chat.canonical(chat.records_of_rows(df))).withColumn("spans", chat.loss_spans(chat.F.col("turns")))
    for r in own.collect():
        assert g.formatted_chars and [r.formatted[s.first : s["last"]] for s in r.spans] == [t.text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;") for t in r.turns if t.role == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    cases = [
        ('{"prompt":"a","completion":"b"}', "prompt", [("user", "a"), ("assistant", "b")]),
        ('{"system":"s","prompt":"a","completion":"b"}', "prompt", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"instruction":"i","input":"x","output":"o"}', "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ('{"instruction":"i","output":"o","unknown":3}', "instruction", [("user", "i"), ("assistant", "o")]),
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant"}]}', "messages", [("user", "q"), ("assistant", "")]),
        ('{"messages":[]}', "messages", []),
        ('{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', "sharegpt", [("user", "h"), ("assistant", "g")]),
        ('{"prompt":"a"}', None, None),
        ('{"prompt":"a","completion":"b","messages":[]}', None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    for r in chat.canonical(chat.from_json(df, "j")).collect():
        turns = None if r.turns is None else [tuple(t) for t in r.turns]
        assert (r.layout, turns) == cases[r.i][1:], cases[r.i]


def test_native_plans_have_no_python(spark, sf_dir):
    from tidegrid.llm import queries

    for name in ("op2_decontamination", "op9_license_scan", "op10_chat_formatting"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from tests.llm.test_matching import brute_classes, brute_leaks, words
    from tests.llm.test_tokens import check_packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = corpus_pipeline.quality_filter(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.select("doc_id").exceptAll(kept.select("doc_id")).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len(gone & set(good)) <= 0.03 * len(good)
    from fractions import Fraction

    unique = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d for d, _, c in brute_classes(rows, Fraction("0.8"), 5) if d == c}
    assert sorted(map(str, (r.doc_id for r in unique.collect()))) == sorted(map(str, want)) and unique.columns == docs.columns
    clean = corpus_pipeline.clean_of_benchmark(spark, docs, sf_dir)
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {r[0] for r in brute_leaks([(d, words(t)) for d, t in rows], items, 10) if r[5]}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - leaks
    assert leaks
    packed = corpus_pipeline.best_fit_packing(spark, docs, sf_dir).collect()
    assert check_packing(packed, rows, 2048)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_decides_by_row(spark, sf_dir):
    """Ids that repeat or are null, columns with names of the stages' own, and empty tables."""
    import corpus_pipeline

    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    rows = [(1, a, 0.123, "w"), (7, a, 0.456, "x"), (7, b, 0.5, "y"), (None, a, 0.6, "z"), (8, None, 0.7, "v"), (9, None, 0.8, "u"), (7, item, 0.9, "t"), (None, item, 1.0, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double, row string").repartition(3)
    got = {r.row for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert got == {"w", "y", "v", "u", "t"}
    got = {r.row for r in corpus_pipeline.clean_of_benchmark(spark, docs, sf_dir).collect()}
    assert got == {"w", "x", "y", "z", "v", "u"}
    kept = corpus_pipeline.quality_filter(spark, docs, sf_dir)
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
