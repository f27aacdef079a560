"""Fusion of per-source ranked lists.

The reference walks rank 0, 1, 2, ... and, inside a rank, the sources in
priority order, keeping the first row per canonical URL and stopping at n.
The survivor of a canonical URL is therefore its occurrence with the least
``(raw_rank, priority)``, and the final order is ``(raw_rank, priority)`` over
the survivors: two window passes, no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanin.functions.urls import with_canonical_url
from fanin.params import MAX_NUM_RESULTS, FusionParams


def priority_col(source: Column | str, params: FusionParams) -> Column:
    """0-based position of the source in the priority list; NULL for unlisted sources.

    The list is a job parameter of a handful of names, so it is a literal
    array in the expression: no join, no broadcast.
    """
    s = F.col(source) if isinstance(source, str) else source
    pos = F.array_position(F.array(*[F.lit(x) for x in params.sources]), s)
    return F.when(pos > 0, (pos - 1).cast("int"))


def source_priority(df: DataFrame, params: FusionParams = FusionParams()) -> DataFrame:
    """Row 14: attach ``priority``; sources not in the list drop out of fusion."""
    return df.withColumn("priority", priority_col("source", params)).filter(F.col("priority").isNotNull())


def with_canonical(df: DataFrame, url: str = "href") -> DataFrame:
    """Row 13 applied to a frame (staged: the URL is split once per row)."""
    return with_canonical_url(df, url, "canonical_url")


def fuse_dedupe(df: DataFrame) -> DataFrame:
    """Row 15: one row per (query, canonical URL): least raw_rank, then best priority.

    Partitioned by (query_id, canonical_url), so even one very large query
    spreads over many tasks.
    """
    w = Window.partitionBy("query_id", "canonical_url").orderBy("raw_rank", "priority")
    return df.withColumn("_d", F.row_number().over(w)).filter(F.col("_d") == 1).drop("_d")


def fuse_interleave_topk(df: DataFrame, n: int | Column = MAX_NUM_RESULTS, most: int = MAX_NUM_RESULTS) -> DataFrame:
    """Row 16: order survivors by (raw_rank, priority), number from 1, keep the first n.

    ``n`` is a constant or a per-row column (e.g. the query's num_results); in
    the second case ``most`` is the caller's bound on it, cut first so that the
    plan gets a partial ``WindowGroupLimit`` ahead of the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy("raw_rank", "priority")
    limit = n if isinstance(n, int) else most
    out = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    if not isinstance(n, int):
        out = out.filter(F.col("rank") <= n)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def drop_failed_sources(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of a source whose call failed or was skipped do not take part."""
    ok = outcomes.filter(F.col("outcome") == "ok").select("query_id", "source")
    return results.join(ok, ["query_id", "source"], "left_semi")


def fuse(results: DataFrame, n: int | Column | None = None, requests: DataFrame | None = None,
         outcomes: DataFrame | None = None, params: FusionParams = FusionParams()) -> DataFrame:
    """Rows 13-16 chained.  ``n`` constant, or per query from ``requests.num_results``."""
    df = results
    if outcomes is not None:
        df = drop_failed_sources(df, outcomes)
    df = fuse_dedupe(with_canonical(source_priority(df, params)))
    if requests is not None:
        # the caller's bound first (partial limit before the shuffle), then each query's own n
        top = fuse_interleave_topk(df, params.max_results)
        return (top.join(requests.select("query_id", F.col("num_results").alias("_n")), "query_id")
                .filter(F.col("rank") <= F.col("_n")).drop("_n"))
    return fuse_interleave_topk(df, params.max_results if n is None else n, params.max_results)


def sources_used(outcomes: DataFrame, requested: tuple[str, ...]) -> DataFrame:
    """Row 17: per query, the sources that answered (in requested order) and those that failed.

    Follows the reference code: a source that answered with zero rows still
    counts, and so does a requested source outside the fusion priority list.
    Lists are bounded by the number of configured sources.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in requested]), F.col("source"))
    item = F.struct(order.alias("o"), F.col("source").alias("s"))
    return (outcomes.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "ok", item))).alias("_ok"),
        F.array_sort(F.collect_list(F.when(F.col("outcome") != "ok", item))).alias("_bad"))
        .select("query_id",
                F.array_join(F.transform("_ok", lambda x: x["s"]), ",").alias("sources_used"),
                F.array_join(F.transform("_bad", lambda x: x["s"]), ",").alias("sources_failed")))


def all_failed(fused: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Row 18: per query status -- 'ok', 'empty' (no rows, nothing failed) or 'error'.

    An error needs both an empty fused list and at least one failed source.
    """
    queries = outcomes.select("query_id").distinct()
    has_rows = fused.select("query_id").distinct().withColumn("_rows", F.lit(True))
    failed = (outcomes.filter(F.col("outcome") != "ok").groupBy("query_id")
              .agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("_failed")))
    j = queries.join(has_rows, "query_id", "left").join(failed, "query_id", "left")
    status = (F.when(F.col("_rows"), F.lit("ok"))
              .when(F.col("_failed").isNotNull(), F.lit("error")).otherwise(F.lit("empty")))
    err = F.when(status == "error", F.concat(F.lit("all search sources failed: "), F.col("_failed")))
    return j.select("query_id", status.alias("status"), err.alias("error"))
