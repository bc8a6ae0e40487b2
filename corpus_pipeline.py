"""Corpus pipeline: each stage works on all rows that the stage before it kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination and best-fit packing, in this order. All
stages but the last return the columns of ``documents``, whatever their names; each result is written to the
shared folder as Parquet and read again. Decisions are taken by row, not by doc_id: rows are numbered, so a
row goes only for its own text, even where ids repeat or are null. Null and empty texts stay in the filtering
stages, if the classifier keeps them, and are one token for the packing. An empty table gives an empty one.
SQL can express neither the classifier nor the packing, so there is no ORACLE_SQL; tests/llm/test_models.py
holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, packing, quality, set_join
from tidegrid.llm.queries import WORD_BPE, table
from tidegrid.llm.shared import materialise, release


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, written so that later reads see the same numbers."""
    row = _unused(docs, "row")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose number isn't in ``gone``."""
    return docs.join(materialise(gone, "gone"), row, "left_anti").drop(row)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; it is fitted on a sample of the labelled ones.

    A null text is scored as an empty one. Rows that repeat an id are scored each by its own text.
    """
    model, name = quality.fit(docs, table(spark, sf_dir, "labels")), _unused(docs, "quality_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents (5-word shingles, 0.8): that of the smallest doc_id.

    Null ids come last; of rows that repeat the smallest id one stays. Texts without words are in no group, so
    all rows of them stay.
    """
    docs, row = _numbered(docs)
    key = docs.select(F.col("doc_id"), F.col(row).alias("n"))
    found = set_join.jaccard_components(docs, threshold="0.8", n=5, id_col=row).select(F.col("doc_id").alias("n"), "component_id")
    # groups of one need no second look
    found = materialise(found, "found")
    many = found.where("n <> component_id").select("component_id").distinct()
    members = found.join(many, "component_id", "left_semi").join(key, "n")
    first = members.groupBy("component_id").agg(F.min_by("n", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("n"))).alias("first"))
    gone = members.join(first, "component_id").where("n <> first").select(F.col("n").alias(row))
    out = _without(docs, row, gone)
    release(found)
    return out


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of a benchmark item occurs; null and empty texts have none."""
    docs, row = _numbered(docs)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, id_col=row)
    return _without(docs, row, found.where("contaminated").select(F.col("doc_id").alias(row)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, WORD_BPE, capacity=2048)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", clean_of_benchmark),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name)
            if before is not None:
                release(before)
            before = docs
    return docs
