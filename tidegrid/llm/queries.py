"""Queries that apply the operators to whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import chat, content_store, decontaminate, licenses, packing, quality, search, set_join, token_counts, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10).drop("items")


OP2_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP2_SQL = f"""
with d as (select doc_id, {OP2_WORDS} as w from documents),
b as (select item_id, {OP2_WORDS} as w from benchmark),
bw as (select distinct item_id, array_to_string(win, ' ') as key, len(win) as m from (
  select item_id, unnest(case when len(w) >= 10 then list_transform(range(1, len(w) - 8), lambda i: list_slice(w, i, i + 9)) when len(w) > 0 then [w] else [] end) as win from b)),
p as (select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as key from (
  select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from bw))),
o as (select p.doc_id, p.i, p.m, bw.item_id from p join bw using (key, m)),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from o) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items from (select distinct doc_id, item_id from o) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
f as (select h, payload_bytes, min(page_id) as first from p group by all),
g as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, 1 + 10 * (i // 8), 10) as bigint) >> (35 - 5 * (i % 8))) & 31)::int, 1), '' order by i) as payload_digest
      from (select distinct h from p), (select unnest(range(32)) as i) group by h)
select page_id, payload_bytes, payload_digest,
       case when page_id is null and first is not null or page_id > first then 'revisit' else 'response' end as record_type,
       case when page_id is null and first is not null or page_id > first then first end as refers_to
from p join f using (h, payload_bytes) join g using (h)
"""


def op5_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_store.store_and_read(table(spark, sf_dir, "documents"), BYTE_BPE)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents"), threshold="0.9", n=3)


OP6_SQL = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from d),
k as (select doc_id, len(g) as n, md5(array_to_string(g, chr(10))) as h, g from s),
u as (select h, any_value(n) as n, any_value(g) as g, min(doc_id) as rep from k where n > 0 group by h),
e as (select rep, n, unnest(g) as x from u),
c as (select a.rep as a, b.rep as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.rep < b.rep and a.n * 100 >= 90 * b.n and b.n * 100 >= 90 * a.n group by 1, 2),
l as (select a, b from c where 100 * shared >= 90 * (na + nb - shared)),
m as (select a, b from l union all select b, a from l),
r(v, root) as (select rep, rep from u union select m.b, r.root from r join m on m.a = r.v and r.root < m.b),
f as (select v, min(root) as root from r group by v)
select k.doc_id, k.n as n_shingles, coalesce(f.root, k.doc_id) as component_id from k left join u using (h) left join f on f.v = u.rep
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=8000)


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 20 = 0"), k=10)


OP8_SQL = f"""
with d as (select doc_id, {OP2_WORDS} as w from documents),
s as (select count(*) as n, sum(len(w)) / count(*) as mean from d),
tf as (select doc_id, x, count(*) as tf from (select doc_id, unnest(w) as x from d) group by all),
f as (select x, count(*) as df from tf group by x),
p as (select tf.doc_id, tf.x, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) as part from tf join f using (x) join d using (doc_id), s),
c as (select q.doc_id as query_id, p.doc_id, round(sum(part), 6) as score from tf q join p using (x) where q.doc_id % 20 = 0 group by all)
select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from c
qualify rank <= 10
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), share=0.8).drop("matches")


_NOTICES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.TEMPLATES)
OP9_SQL = f"""
with t as (select license_id, {OP2_WORDS} as w from (values {_NOTICES}) v(license_id, text)),
tg as (select license_id, greatest(8, 2 ** ceil(log2(len(w))))::bigint as c, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) as g from t),
te as (select license_id, c, len(g) as n, unnest(g) as x from tg),
d as (select doc_id, {OP2_WORDS} as w from documents),
p as (select doc_id, i - 1 as pos, array_to_string(list_slice(w, i, i + 2), ' ') as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
m as (select doc_id, license_id, n, x, pos // c - k as win from p join te using (x), (values (0), (1)) kk(k)),
h as (select distinct doc_id, license_id from (select doc_id, license_id, win, n, count(distinct x) as f from m group by all) where f >= 0.8 * n)
select d.doc_id, count(license_id) as n_licenses, coalesce(string_agg(license_id, ',' order by license_id), '') as license_ids
from d left join h using (doc_id) group by d.doc_id
"""


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_digests(chat.format_conversations(rows))


OP10_SQL = """
with r as (select conv_id, turn, role, text from conversations union all
  select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from r),
e as (select *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') as er, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') as et from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(er) + length(et) + 24)::bigint as formatted_chars
from e group by conv_id
"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_warc": op4_warc,
    "op5_content_store": op5_content_store,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_top_k_search": op8_top_k_search,
    "op9_license_scan": op9_license_scan,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op8_top_k_search": OP8_SQL,
    "op9_license_scan": OP9_SQL,
    "op10_chat_formatting": OP10_SQL,
}
