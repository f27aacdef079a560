"""Connected components by alternating large and small stars: every round is a few aggregates and joins, hubs
included (``common.join_back``), and rounds grow with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.llm.common import join_back, materialise


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))
    return join_back(edges, least, ["u"], "w", F.bitwise_not("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _least(both).filter("v > u")
    return out.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    out = _least(down)
    links = out.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionAll(out.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long, u <> v); root is the component's smallest node."""
    edges = materialise(edges.select("u", "v").distinct(), "edges")
    state, rows = None, edges.count()
    while True:
        # a star has no more edges than there were
        edges = materialise(_small_star(_large_star(edges).distinct()).filter("u <> v").distinct(), "stars", rows)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
