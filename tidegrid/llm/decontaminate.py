"""Benchmark decontamination by a prefix-filtered set join (operator 2), in DataFrame functions throughout.

A benchmark item's window of consecutive words is a set of shingles. Shingles are ordered by how often the
whole corpus has them. As a window must be contained wholly, one shingle, its rarest, is a necessary prefix:
a document that lacks it cannot contain the window. So documents meet windows by that shingle alone. The
place of the shingle gives the only place where the window can stand; length and positional bounds drop
places that overrun the text, and the words there are compared one by one, which makes the result exact.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import materialise

#: What separates words once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of a benchmark up to this number (some 300 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 100_000
#: Key of the place behind a document's last word; xxhash64 of words may equal it, the comparison tells.
END_KEY = -1


def words(text: Column) -> Column:
    """The words of a text; a null text has none. Only A-Z change case."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """window (array of words) and items (ids as strings, sorted) of all distinct windows of the items."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0 and item is not null")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.slice(F.col("w"), i, n))
    return own.select("item", F.explode(each).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _key(array: str, at: Column, size: int) -> Column:
    """Hash of the shingle of ``size`` words that begins at ``at`` (from 0)."""
    return F.xxhash64(*[F.get(F.col(array), at + j) for j in range(size)])


def _dealt(frame: DataFrame, n_windows: int) -> DataFrame:
    return F.broadcast(frame) if n_windows <= BROADCAST_WINDOWS else frame


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items.

    A window is ``n`` consecutive words of an item; an item with fewer, but some, is one window. n_hit counts
    the document's words inside any occurrence of a window; items are the ids (as strings, sorted) of items
    with an occurring window, items_sha256 the hash of them joined by commas. Null and empty texts have no
    words and no hits; items without words or id match nothing. Rows with a null id are kept; equal rows give
    equal results, as many times; other columns are ignored. Empty tables give no hits, or no rows.

    Cost: two scans of the documents. A window that a third of all documents hold costs each of them a row
    per occurrence; rows are grouped by document only. Nothing of documents is broadcast or collected.
    """
    found = materialise(windows(items, n, item_col, item_text_col).withColumn("wid", F.xxhash64(F.array_join("window", " "))), "windows")
    n_windows = found.count()
    sizes = sorted(r[0] for r in found.select(F.least(F.size("window"), F.lit(shingle))).distinct().collect())  # at most ``shingle`` values
    part = [found.where(F.least(F.size("window"), F.lit(shingle)) == k).select("wid", "window", "items", F.explode(F.sequence(F.lit(0), F.size("window") - k)).alias("off"), F.lit(k).alias("k")).withColumn("key", _key("window", F.col("off"), k)) for k in sizes]
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_h"), words(F.col(text_col)).alias("w"))
    prefix = []
    if part:
        grams = part[0]
        for x in part[1:]:
            grams = grams.unionByName(x)
        # how often the corpus has each shingle of the benchmark
        seen = None
        for k in sizes:
            wanted = _dealt(grams.where(F.col("k") == k).select("key").distinct(), n_windows)
            at = own.select("w", F.posexplode("w").alias("pos", "_w")).select(_key("w", F.col("pos"), k).alias("key"))
            counts = at.join(wanted, "key").groupBy("key").agg(F.count("*").alias("seen")).withColumn("k", F.lit(k))
            seen = counts if seen is None else seen.unionByName(counts)
        seen = materialise(seen, "rarity")  # at most one row per shingle of the benchmark
        rank = F.struct(F.coalesce("seen", F.lit(0)), "key", "off")
        prefix = grams.join(_dealt(seen, n_windows), ["key", "k"], "left").groupBy("window").agg(*[F.min_by(c, rank).alias(c) for c in ("wid", "key", "off", "k", "items")])
        prefix = materialise(prefix.select("wid", "key", "off", "k", "window", "items"), "prefix")
    ends = docs.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("wid"), F.lit(END_KEY).cast("bigint").alias("key"), F.lit(0).alias("off"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))
    prefix = prefix.unionByName(ends) if part else ends
    # every document also has a place behind its last word, so that its row is there without a match
    places = own.select("doc_id", "_h", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    if len(sizes) <= 1:
        k = sizes[0] if sizes else shingle
        places = places.withColumn("key", F.when(F.col("word") == "", F.lit(END_KEY)).otherwise(_key("w", F.col("pos"), k))).withColumn("k", F.when(F.col("word") == "", F.lit(0)).otherwise(F.lit(k)))
    else:
        each = F.when(F.col("word") == "", F.array(F.struct(F.lit(0).alias("k"), F.lit(END_KEY).cast("bigint").alias("key")))).otherwise(F.array(*[F.struct(F.lit(k).alias("k"), _key("w", F.col("pos"), k).alias("key")) for k in sizes]))
        places = places.withColumn("own", F.explode(each)).select("doc_id", "_h", "w", "pos", "word", F.col("own.k").alias("k"), F.col("own.key").alias("key"))
    met = places.join(_dealt(prefix, n_windows), ["key", "k"])
    start, m = F.col("pos") - F.col("off"), F.size("window")
    fits = (start >= 0) & (start + m <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, m) == F.col("window")
    met = met.where(F.col("wid").isNull() | (fits & same))
    hit = F.col("wid").isNotNull()
    grouped = met.groupBy("doc_id", "_h").agg(
        F.max(F.when(~hit, F.col("pos"))).alias("n_words"),
        F.sum(F.when(~hit, 1).otherwise(0)).alias("_rows"),
        F.collect_set(F.when(hit, F.struct(start.alias("first"), (start + m).alias("end")))).alias("spans"),
        F.collect_set(F.when(hit, F.col("items"))).alias("items"),
    )
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["first"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    n_hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])
    out = grouped.select("doc_id", "_h", "_rows", F.col("n_words").cast("bigint").alias("n_words"), n_hit.cast("bigint").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    out = out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int"))).alias("_copy"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
