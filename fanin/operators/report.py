"""Reports and run measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.functions.urls import with_result_domain

REPORT_FIELDS = ("rank", "title", "url", "snippet", "source", "published_us", "status", "fetch_method",
                 "cached", "content_length", "content", "error")


def report_rows(fused: DataFrame, pages: DataFrame, on_length: bool = False) -> DataFrame:
    """Row 46: fused results joined to resolved pages by URL, with the report's defaults.

    Missing page -> status 0, method NULL, cached false, length 0, content ''.
    ``on_length``: pages are per (URL, content length ``_ml``) and so is the join.
    """
    extra = [F.col("_ml").alias("_pml")] if on_length else []
    p = pages.select(*extra, F.col("url").alias("_url"), F.col("status").alias("_status"),
                     F.col("method").alias("_method"),
                     (F.col("cached") if "cached" in pages.columns else F.lit(False)).alias("_cached"),
                     F.col("content_length").alias("_len"), F.col("content").alias("_content"),
                     F.col("error").alias("_error"))
    cond = fused["href"] == p["_url"]
    if on_length:
        cond = cond & (fused["_ml"] == p["_pml"])
    j = fused.join(p, cond, "left")
    return j.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"), F.coalesce(F.col("href"), F.lit("")).alias("url"),
        F.coalesce(F.col("body"), F.lit("")).alias("snippet"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.col("published_us"),
        F.coalesce(F.col("_status"), F.lit(0)).cast("int").alias("status"),
        F.col("_method").alias("fetch_method"),
        F.coalesce(F.col("_cached"), F.lit(False)).alias("cached"),
        F.coalesce(F.col("_len"), F.lit(0)).cast("bigint").alias("content_length"),
        F.coalesce(F.col("_content"), F.lit("")).alias("content"),
        F.col("_error").alias("error"))


def report_nested(rows: DataFrame, used: DataFrame | None = None, with_content: bool = False,
                  queries: DataFrame | None = None) -> DataFrame:
    """Row 47: one row per query: num_results and the rows ordered by rank.

    With ``queries(query_id)`` a query without results has its row too: count 0
    and an empty list.  The gathered list is one query's fused results, bounded
    by the query's n; content is left out unless asked for.
    """
    fields = [f for f in REPORT_FIELDS if with_content or f != "content"]
    per_q = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("num_results"),
        F.array_sort(F.collect_list(F.struct(*fields))).alias("sources"))
    if queries is not None:
        asked = queries.select("query_id").distinct()
        none = F.array().cast(per_q.schema["sources"].dataType)
        per_q = asked.join(per_q, "query_id", "left").select("query_id", F.coalesce("num_results", F.lit(0)).alias("num_results"),
                                                             F.coalesce("sources", none).alias("sources"))
    if used is not None:
        per_q = per_q.join(used.select("query_id", "sources_used"), "query_id", "left")
    return per_q


def with_domain(df: DataFrame, url: str = "url") -> DataFrame:
    """Row 48 (staged: the URL is split once per row)."""
    return with_result_domain(df, url, "domain")


def scrape_scorecard(rows: DataFrame, query_status: DataFrame, run: str | None = None) -> DataFrame:
    """Row 49: per run, queries ok/total, pages ok/total, success % to one decimal.

    Both inputs are tagged and unioned so one aggregate (partial per
    partition) yields the row of each run; without ``run`` there is one run.
    """
    keys = [run] if run else []
    q = query_status.select(*keys, F.lit(True).alias("_q"), (F.col("status") != "error").alias("_ok"))
    pg = rows.select(*keys, F.lit(False).alias("_q"), ((F.col("status") == 200) & (F.col("content") != "")).alias("_ok"))
    both = q.unionByName(pg)
    aggs = [F.count_if(F.col("_q") & F.col("_ok")).alias("queries_ok"), F.count_if(F.col("_q")).alias("queries_total"),
            F.count_if(~F.col("_q") & F.col("_ok")).alias("pages_ok"), F.count_if(~F.col("_q")).alias("pages_total")]
    out = both.groupBy(*keys).agg(*aggs) if keys else both.agg(*aggs)
    pct = F.when(F.col("pages_total") > 0, F.round(F.lit(100.0) * F.col("pages_ok") / F.col("pages_total"), 1)) \
        .otherwise(F.lit(0.0))
    return out.withColumn("success_pct", pct)


def failed_pages(rows: DataFrame) -> DataFrame:
    """Row 50: rows whose error is set or whose content is empty."""
    return rows.filter(F.col("error").isNotNull() | (F.col("content") == "")).select(
        "query_id", "rank", "url", "status", "content_length", "error")


def error_breakdown(rows: DataFrame) -> DataFrame:
    """Row 50: failed pages counted by error."""
    return failed_pages(rows).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def coverage(fused: DataFrame, min_per_query: int = 20, min_total: int = 180, min_domains: int = 100,
             exact: bool = True) -> DataFrame:
    """Row 51: results per query, total, distinct domains, pass flag.

    One pass over the fused rows: a partial aggregate to ``(query_id, domain,
    n)``, then grouping sets ``(query_id)`` and ``(domain)`` over that small
    table, then one global row.  Distinct domains are exact; ``exact=False``
    counts them with a HyperLogLog sketch in one aggregate instead (about 2%
    relative error), which needs no per-domain rows at all.
    """
    if not exact:
        doms = with_result_domain(fused.select("query_id", "href"), "href", "_d")
        per_q = doms.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"),
                                            F.hll_sketch_agg("_d").alias("_s"))
        out = per_q.agg(
            F.count(F.lit(1)).alias("queries_total"),
            F.count_if(F.col("_n") >= min_per_query).alias("queries_ok"),
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("results_total"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("_s")), F.lit(0)).alias("unique_domains"))
        return out.withColumn("passed", (F.col("results_total") >= min_total)
                              & (F.col("unique_domains") >= min_domains))
    qd = (with_result_domain(fused.select("query_id", "href"), "href", "_d")
          .groupBy("query_id", "_d").agg(F.count(F.lit(1)).alias("_n")))
    sets = qd.groupingSets([["query_id"], ["_d"]], "query_id", "_d").agg(
        F.sum("_n").alias("_n"), F.grouping("query_id").alias("_gq"))
    is_q = F.col("_gq") == 0
    out = sets.agg(
        F.count_if(is_q).alias("queries_total"),
        F.count_if(is_q & (F.col("_n") >= min_per_query)).alias("queries_ok"),
        F.coalesce(F.sum(F.when(is_q, F.col("_n"))), F.lit(0)).cast("bigint").alias("results_total"),
        F.count_if(~is_q).alias("unique_domains"))
    return out.withColumn("passed", (F.col("results_total") >= min_total) & (F.col("unique_domains") >= min_domains))


def scaling_check(small: DataFrame, big: DataFrame) -> DataFrame:
    """Row 52: per query, the larger request must return more rows."""
    a = small.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_small"))
    b = big.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_big"))
    return (a.join(b, "query_id", "full")
            .select("query_id", F.coalesce("n_small", F.lit(0)).alias("n_small"),
                    F.coalesce("n_big", F.lit(0)).alias("n_big"))
            .withColumn("scaled", F.col("n_big") > F.col("n_small")))


def result_set_diff(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Row 53: ranks where two runs differ on href (full outer join on query and rank)."""
    a = run_a.select("query_id", "rank", F.col("href").alias("href_a"))
    b = run_b.select("query_id", "rank", F.col("href").alias("href_b"))
    return a.join(b, ["query_id", "rank"], "full").filter(~F.col("href_a").eqNullSafe(F.col("href_b")))


def result_set_changes(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Row 53 set-wise: ``query_id, href, n_a, n_b`` where two runs hold an href unequally often, whatever its rank.

    A digest that no order changes (count, sum and xor of two hashes of the hrefs) is built per query with map-side
    aggregates; only queries whose digests differ go on to be compared row by row."""
    def digest(run, side):
        h, g = F.xxhash64("href"), F.xxhash64(F.lit(7), "href")
        return run.groupBy("query_id").agg(F.struct(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(g)).alias(f"_d{side}"))

    a, b = digest(run_a, 0), digest(run_b, 1)
    b = b.withColumnRenamed("query_id", "_q")
    unequal = a.join(b, a["query_id"].eqNullSafe(b["_q"]), "full").filter(~F.col("_d0").eqNullSafe(F.col("_d1")))
    unequal = unequal.select(F.coalesce("query_id", "_q").alias("_q"))
    both = (run_a.select("query_id", "href", F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(run_b.select("query_id", "href", F.lit(0).alias("a"), F.lit(1).alias("b"))))
    kept = both.join(unequal, both["query_id"].eqNullSafe(unequal["_q"]), "left_semi")
    return (kept.groupBy("query_id", "href").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
            .filter(F.col("n_a") != F.col("n_b")))
