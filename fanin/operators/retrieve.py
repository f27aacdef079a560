"""Batch ranked lookup of many queries over a page corpus.

Stands in for the upstream search calls: one ranked list per (query,
source), at most ``k`` rows.  Integer scoring, so results are exactly
checkable: distinct matched terms desc, total term hits desc, page id asc.
Every term counts, however frequent.  Documents are dealt into blocks; a
query's scores are summed and cut to ``k`` inside each block, so that only
``k`` rows per query and block meet in the final cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN_RE = r"[\p{L}\p{N}]+"
BLOCKS = 64


def tokens(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_RE), 0)


def postings(docs: DataFrame, doc_id: str, text: Column, blocks: int = BLOCKS) -> DataFrame:
    """``(block, term, doc_id, tf)``: partial counts on the map side, one shuffle."""
    per = docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokens(text)).alias("term"))
    return (per.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
            .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return (queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(text))).alias("term")))


def retrieve_ranked(queries: DataFrame, post: DataFrame, k: int, source: str) -> DataFrame:
    """Top ``k`` docs per query: ``query_id, source, raw_rank (0-based), doc_id, n_terms, hits``.

    The term join is an equi-join (AQE splits skewed terms); scores are partial
    aggregates; the first cut runs per (query, block), so a frequent query
    spreads over the blocks, and the last one sees ``k`` rows per block.
    """
    hits = (queries.join(post, "term")
            .groupBy("query_id", "block", "doc_id")
            .agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("hits")))
    best = (F.col("n_terms").desc(), F.col("hits").desc(), F.col("doc_id"))
    local = Window.partitionBy("query_id", "block").orderBy(*best)
    hits = hits.withColumn("_b", F.row_number().over(local)).filter(F.col("_b") <= k)
    w = Window.partitionBy("query_id").orderBy(*best)
    return (hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
            .select("query_id", F.lit(source).alias("source"), (F.col("_rn") - 1).cast("int").alias("raw_rank"),
                    "doc_id", F.col("n_terms").cast("bigint").alias("n_terms"), F.col("hits").cast("bigint").alias("hits")))
