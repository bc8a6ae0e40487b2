"""Connected components of a link table, in DataFrame joins (large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import materialise, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node of its component) of every node that a link names.

    Self links and repeated links do no harm; null ends are ignored. Each round is written to the
    shared folder, so lineage stays short and a lost executor costs one round at most. Minima are
    aggregated before the shuffle, and joins on a node with very many links are left to adaptive
    splitting; nothing is collected.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), (F.col(a) == F.col(b)).alias("same")).where("not same").select("hi", "lo").distinct(), "edges")
    over = edges.isEmpty()
    while not over:
        # large star: every neighbour above v is linked with the least neighbour of v
        both = edges.select(F.col("hi").alias("v"), F.col("lo").alias("u")).unionByName(edges.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.where("hi <> lo").distinct(), "large")
        # small star: every lower neighbour of v, and v, are linked with the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo")).where("hi <> lo")
        after = materialise(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "small")
        release(large)
        # no change is left when each node has one link, to a node that has none upwards
        over = after.select("lo").join(after.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty() and after.groupBy("hi").count().where("count > 1").isEmpty()
        release(edges)
        edges = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
