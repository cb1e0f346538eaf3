"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step joins the edges with each node's smallest neighbour, so no node's neighbours are ever gathered, and those of a node with
very many are dealt in shares; the edges of each round are kept in the shared folder. A star with any number of leaves stays one
row a leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


#: Neighbours from which on a node's edges are dealt in SALTS shares.
HUB, SALTS = 1000, 32


def _beside_least(rows: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """rows with m of least (node, m, n) beside each; the edges of hubs, which may be a third of all, are dealt in shares."""
    hubs = least.filter(F.col("n") > HUB).select(node, F.lit(SALTS).alias("salts"))  # at most edges / HUB; Spark checks its size
    dealt = rows.join(hubs, node, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("salts", F.lit(1))))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), (F.when(F.col("n") > HUB, SALTS).otherwise(1) - 1).cast("long"))).alias("salt")
    return dealt.join(least.select(node, "m", shares), [node, "salt"]).drop("salt", "salts")


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a < b) with each node's neighbours hung on its smallest one: the larger neighbours (large star) or the smaller ones."""
    if large:
        seen = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
        least = seen.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        out = _beside_least(edges, "a", least).select(F.col("m").alias("a"), "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        out = _beside_least(edges, "b", least).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return out.filter("a < b").distinct()


#: Edges in one file of a round's table.
TOGETHER = 50_000


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable), for each node of edges (a, b) of one sortable type; nodes without edges have no row."""
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    mark = None
    while True:
        # stars only: the edges stay as they are, and so do their count and sum of hashes
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark, before = seen, now
        now = stored(_step(_step(now, True), False).coalesce(1 + seen[0] // TOGETHER))
        discard(before)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
