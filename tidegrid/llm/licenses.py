"""License scans: MinHash bands over overlapping text windows, then exact containment (operator 9).

All in DataFrame functions. Of a document's word shingles only those that some template has are kept, so what a
window says about a template does not depend on the prose around it. Templates are put in classes by span
(8, 16, 32, ... words); the windows of class c are 2c words long and begin every c words, so a passage of at
most c words lies wholly in one of them. A window's MinHash values are compared with those of the templates
of its class, one value to a band: a template that makes up a share J of what both have is retrieved with
probability 1 - (1 - J)**BANDS, 0.9999 for a window that two templates share evenly (J = 0.25 with BANDS = 32).
Retrieved templates are verified by the exact share of their shingles that the window has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.decontaminate import words
from tidegrid.llm.shared import materialise

BANDS, SHINGLE = 32, 3
#: Template shingles up to this number (some 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SHINGLES = 200_000

#: Common license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates(spark: SparkSession) -> DataFrame:
    """license_id and text of the notices above."""
    return spark.createDataFrame(list(TEMPLATES), "license_id string, text string")


def _grams(w: str):
    """Shingles of the word array ``w``; of fewer words, all of them as one."""
    last = F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(F.col(w), i, SHINGLE), " "))


def _bands(grams: str):
    """(band, value) of a set of shingles."""
    one = lambda b: F.array_min(F.transform(grams, lambda g: F.xxhash64(F.lit(b), g)))
    return F.array(*[F.struct(F.lit(b).alias("band"), one(b).alias("value")) for b in range(BANDS)])


def scan(docs: DataFrame, notices: DataFrame | None = None, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_licenses, license_ids, and matches.

    A template matches if a window of its class has at least ``share`` of its distinct shingles. license_ids
    are the matching ids, sorted and joined by commas; matches has license_id, share and first word for each.
    Templates of fewer than three words match as a whole only where these begin a shingle of a text of no more
    words. Null and empty texts match nothing; null ids are kept; equal rows give equal results, as many
    times; other columns are ignored. Empty tables give no matches, or no rows.

    One scan of the documents; only shingles of templates leave it. A notice that a third of all documents
    have is a few rows in each of them; rows are grouped by document and window only.
    """
    spark = docs.sparkSession
    notices = templates(spark) if notices is None else notices
    own = notices.select(F.col("license_id").cast("string").alias("license_id"), words(F.col("text")).alias("w")).where("size(w) > 0 and license_id is not null")
    own = own.select("license_id", F.array_distinct(_grams("w")).alias("grams"), F.size("w").alias("span"))
    own = materialise(own.withColumn("class", F.greatest(F.lit(8), F.pow(2, F.ceil(F.log2("span"))).cast("int"))), "templates")
    grams = own.select(F.explode("grams").alias("gram")).distinct()
    n_grams = grams.count()
    classes = sorted(r[0] for r in own.select("class").distinct().collect())  # one for each doubling of length
    wanted = grams.select(F.xxhash64("gram").alias("key"), "gram").unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("key"), F.lit("").alias("gram")))
    if n_grams <= BROADCAST_SHINGLES:
        wanted, own = F.broadcast(wanted), F.broadcast(own)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_h"), words(F.col(text_col)).alias("w"))
    # the place behind the last word keeps the row of every document
    places = rows.select("doc_id", "_h", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    gram = F.concat_ws(" ", *[F.get("w", F.col("pos") + j) for j in range(SHINGLE)])
    places = places.where(F.col("word").eqNullSafe("") | (F.col("pos") <= F.greatest(F.size("w") - SHINGLE, F.lit(0))))
    # an empty word is at the end alone; all others are keyed by the hash of their shingle and compared in full
    places = places.select("doc_id", "_h", "pos", F.when(F.col("word") == "", F.lit("")).otherwise(gram).alias("gram"))
    met = places.withColumn("key", F.when(F.col("gram") == "", F.lit(-1)).otherwise(F.xxhash64("gram"))).join(wanted, ["key", "gram"]).drop("key")
    if not classes:
        met = met.where("gram = ''")
    cells = F.array(*[F.struct(F.lit(c).alias("class"), (F.floor(F.col("pos") / c) - F.lit(k)).cast("bigint").alias("window")) for c in classes for k in (0, 1)]) if classes else F.array().cast("array<struct<class: int, window: bigint>>")
    ends = F.array(F.struct(F.lit(-1).alias("class"), F.lit(-1).cast("bigint").alias("window")))
    met = met.select("doc_id", "_h", "pos", "gram", F.explode(F.when(F.col("gram") == "", ends).otherwise(cells)).alias("cell"))
    windows = met.groupBy("doc_id", "_h", F.col("cell.class").alias("class"), F.col("cell.window").alias("window")).agg(F.collect_set("gram").alias("found"), F.min("pos").alias("first"), F.count("*").alias("n"))
    windows = materialise(windows, "windows")
    rest = windows.where("class >= 0")
    signed = rest.select("doc_id", "_h", "class", "window", "found", "first", F.explode(_bands("found")).alias("b"))
    known = own.select("license_id", "grams", "class", F.explode(_bands("grams")).alias("b"))
    near = signed.join(known, ["class", "b"]).select("doc_id", "_h", "class", "window", "license_id", "grams", "found", "first")
    exact = F.size(F.array_intersect("grams", "found")) / F.size("grams")
    hits = near.withColumn("share", exact).where(F.col("share") >= share).groupBy("doc_id", "_h", "license_id").agg(F.max_by(F.struct("share", "first"), F.struct("share", -F.col("first"))).alias("best"))
    hits = hits.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_list(F.struct("license_id", "best.share", "best.first"))).alias("matches"))
    base = windows.where("class < 0").select("doc_id", "_h", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_copy"))
    hits = hits.withColumnsRenamed({"doc_id": "_id", "_h": "_k"})
    out = base.join(hits, base["doc_id"].eqNullSafe(hits["_id"]) & (base["_h"] == hits["_k"]), "left")
    matches = F.coalesce("matches", F.array().cast(hits.schema["matches"].dataType))
    return out.select("doc_id", F.size(matches).cast("bigint").alias("n_licenses"), F.array_join(matches["license_id"], ",").alias("license_ids"), matches.alias("matches"))
