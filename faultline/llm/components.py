"""Connected components of a table of links, by joins on written tables; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``links`` (a, b; longs) reaches, itself included.

    Rounds of large-star and small-star steps turn the links into stars around the smallest node; a
    node's links are reduced by min and joined with the minimum, never held as a list.
    """
    edges = store.written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, move to the node's smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = store.written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).head()
        store.dropped(edges)
        edges = nxt
        if now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
