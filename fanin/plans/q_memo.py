"""Registered queries for the TTL memo."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanin.operators import capture as CA
from fanin.operators import fuse as FU
from fanin.operators import memo as ME
from fanin.plans.q_capture import resolve_ctes, resolved
from fanin.plans.q_search import PARAMS, SERP_N, Ctx, serp_ctes
from fanin.session import scratch_path
from fanin.sources.sinks import write_snapshot
from fanin.plans.registry import register
from fanin.sources import fixtures as fx

AS_OF = fx.MEMO_AS_OF_US
TTL = 21600
PRUNE_N = 50
FMT, MAX_LEN = "markdown", CA.ResolveParams().max_len


def memo_keyed(c: Ctx):
    m = c.v("memo")
    return m.select(ME.fetch_key("url", "fmt", "max_len").alias("key"), "url", "ts_us", "status", "content")


def memo_whole(c: Ctx):
    """The memo with its whole payload, as the research calls read it."""
    m = c.v("memo")
    return m.select(ME.fetch_key("url", "fmt", "max_len").alias("key"), "ts_us", "status", "title", "content", "content_length",
                    "method", "error")


def fetch_requests(c: Ctx):
    return c.v("pg").select("url", ME.fetch_key(F.col("url"), F.lit(FMT), F.lit(MAX_LEN)).alias("key"))


def admitted(c: Ctx):
    r = ME.admit_fetches(resolved(c))
    return r.select("url", ME.fetch_key(F.col("url"), F.lit(FMT), F.lit(MAX_LEN)).alias("key"), "status", "content",
                    "content_length")


# ---- DuckDB -----------------------------------------------------------------
MK = ("mk", "SELECT sha256(concat_ws('|', 'fetch', url, fmt, CAST(max_len AS VARCHAR))) AS key, url, ts_us, status, content, content_length, method, error FROM memo")
EXPIRED = f"({AS_OF} - coalesce(ts_us, 0) > {TTL * 1_000_000})"
FKEY = f"sha256(concat_ws('|', 'fetch', url, '{FMT}', '{MAX_LEN}'))"
ADM = ("admitted", f"SELECT url, {FKEY} AS key, status, content, content_length FROM resolved WHERE status = 200 AND content <> ''")


def with_resolve(*extra):
    return fx.duckdb_with("captures", "pdf_capture_pages", "memo", ctes=resolve_ctes() + [MK, *extra])


@register("memo_key", fx.duckdb_with("memo", "search_requests") + f"""
SELECT 'fetch' AS kind, url AS subject, sha256(concat_ws('|', 'fetch', url, fmt, CAST(max_len AS VARCHAR))) AS key FROM memo
UNION ALL
SELECT 'search', query_id, sha256(concat_ws('|', 'search', query_id, CAST(num_results AS VARCHAR), time_range, '{",".join(PARAMS.sources)}'))
FROM search_requests""")
def q_memo_key(spark, sf):
    c = Ctx(spark, sf)
    f = c.v("memo").select(F.lit("fetch").alias("kind"), F.col("url").alias("subject"),
                           ME.fetch_key("url", "fmt", "max_len").alias("key"))
    s = c.v("search_requests").select(F.lit("search").alias("kind"), F.col("query_id").alias("subject"),
                                      ME.search_key("query_id", "num_results", "time_range", PARAMS.sources).alias("key"))
    return f.unionByName(s)


@register("memo_split", fx.duckdb_with("pg", "memo", ctes=[MK]) + f"""
SELECT rq.url, rq.key, f.key IS NOT NULL AS cached, f.status AS memo_status, f.content AS memo_content
FROM (SELECT url, {FKEY} AS key FROM pg) rq
LEFT JOIN (SELECT * FROM mk WHERE NOT {EXPIRED}) f ON f.key = rq.key""")
def q_memo_split(spark, sf):
    c = Ctx(spark, sf)
    return ME.split(fetch_requests(c), memo_keyed(c), AS_OF, TTL).select(
        "url", "key", "cached", "memo_status", "memo_content")


@register("memo_admit", with_resolve(ADM) + "SELECT url, key, status, content_length FROM admitted")
def q_memo_admit(spark, sf):
    return admitted(Ctx(spark, sf)).select("url", "key", "status", "content_length")


@register("memo_admit_search", fx.duckdb_with("serp_big", "serp_outcomes", ctes=[
    ("oksrc", "SELECT s.* FROM serp_big s WHERE EXISTS (SELECT 1 FROM serp_outcomes o WHERE o.query_id = s.query_id "
              "AND o.source = s.source AND o.outcome = 'ok')")] + [(n, q.replace("FROM serp_big", "FROM oksrc")) for n, q in serp_ctes(str(SERP_N))]) + f"""
SELECT q.query_id, sha256(concat_ws('|', 'search', q.query_id, '{SERP_N}', '', '{",".join(PARAMS.sources)}')) AS key,
       CAST(coalesce(f.n, 0) AS BIGINT) AS n_results
FROM (SELECT DISTINCT query_id FROM serp_outcomes) q
LEFT JOIN (SELECT query_id, count(*) AS n FROM fused GROUP BY query_id) f ON f.query_id = q.query_id
WHERE f.query_id IS NOT NULL OR q.query_id NOT IN (SELECT query_id FROM serp_outcomes WHERE outcome <> 'ok')""")
def q_memo_admit_search(spark, sf):
    """Row 36, searches: every result set that did not error is remembered, empty or partial ones too."""
    c = Ctx(spark, sf)
    outcomes = c.v("serp_outcomes")
    fused = FU.fuse(c.v("serp_big"), n=SERP_N, outcomes=outcomes, params=PARAMS)
    admitted = ME.admit_searches(FU.all_failed(fused, outcomes))
    counts = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    return (admitted.join(counts, "query_id", "left")
            .select("query_id", ME.search_key("query_id", F.lit(SERP_N), F.lit(""), PARAMS.sources).alias("key"),
                    F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results")))


@register("memo_upsert", with_resolve(ADM) + f"""
SELECT key, ts_us, status, CAST(length(content) AS BIGINT) AS content_length FROM (
  SELECT key, ts_us, status, content, 0 AS gen FROM mk
  UNION ALL SELECT key, {AS_OF} AS ts_us, status, content, 1 AS gen FROM admitted) u
QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(ts_us, 0) DESC, gen DESC) = 1""")
def q_memo_upsert(spark, sf):
    """Row 37: last write per key wins; the next memo snapshot goes to a new folder and is read back."""
    c = Ctx(spark, sf)
    new = admitted(c).select("key", "url", F.lit(AS_OF).cast("bigint").alias("ts_us"), "status", "content")
    up = ME.upsert(memo_keyed(c), new)
    path = scratch_path(spark, "memo-snapshot")
    write_snapshot(up, path)
    snap = spark.read.schema(up.schema).parquet(path)
    return snap.select("key", "ts_us", "status", F.length("content").cast("bigint").alias("content_length"))


@register("memo_prune", fx.duckdb_with("memo", ctes=[MK]) +
          f"SELECT key, ts_us FROM mk ORDER BY ts_us DESC NULLS LAST, key LIMIT {PRUNE_N}")
def q_memo_prune(spark, sf):
    return ME.prune(memo_keyed(Ctx(spark, sf)), PRUNE_N).select("key", "ts_us")


@register("memo_purge", with_resolve() + f"""
SELECT key, ts_us FROM mk WHERE NOT {EXPIRED}
AND key NOT IN (SELECT {FKEY} FROM resolved WHERE content = '')""")
def q_memo_purge(spark, sf):
    c = Ctx(spark, sf)
    failed = CA.capture_errors(resolved(c)).select(ME.fetch_key(F.col("url"), F.lit(FMT), F.lit(MAX_LEN)).alias("key"))
    return ME.purge(memo_keyed(c), AS_OF, TTL, delete_keys=failed).select("key", "ts_us")


@register("memo_stats", fx.duckdb_with("memo", ctes=[MK]) + f"""
SELECT count(*) AS entries, CAST(coalesce(sum(strlen(coalesce(content, ''))), 0) AS BIGINT) AS size_bytes,
       coalesce(max(CAST({AS_OF} - ts_us AS DOUBLE) / CAST(1000000 AS DOUBLE)), 0.0) AS oldest_age_s,
       coalesce(min(CAST({AS_OF} - ts_us AS DOUBLE) / CAST(1000000 AS DOUBLE)), 0.0) AS newest_age_s FROM mk""")
def q_memo_stats(spark, sf):
    from fanin import api
    return api.engine_status(memo_keyed(Ctx(spark, sf)), AS_OF)
