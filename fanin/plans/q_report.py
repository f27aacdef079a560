"""Registered queries for reports and run measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanin.operators import fuse as FU
from fanin.operators import report as RE
from fanin.params import SEARCH_TTL_S, FusionParams
from fanin.plans import sqlx as X
from fanin.plans.q_capture import resolve_ctes
from fanin.plans.q_search import PARAMS, REQUESTED, SEARCH_VIEWS, Ctx, search_ctes, searched, serp_ctes, serp_fused
from fanin.plans.registry import register
from fanin.session import ensure_checkpoint_dir
from fanin.sources import fixtures as fx

REVERSED = FusionParams(sources=("b", "a"))


def fused_once(c: Ctx):
    """The fused lists, written once: they name the captures to resolve, join the pages and tell each query's status."""
    ensure_checkpoint_dir(c.spark)
    return searched(c).checkpoint(eager=True)


def rows(c: Ctx, fused=None):
    """Report rows: only captures of URLs that some result names are extracted."""
    from fanin import api
    from fanin.plans.q_capture import P
    fused = fused_once(c) if fused is None else fused
    named = fused.select(F.col("href").alias("url")).distinct()
    pages = api.scrape(c.v("captures").join(named, "url", "left_semi"),
                       c.v("pdf_capture_pages").join(named, "url", "left_semi"), P)
    return RE.report_rows(fused, pages)


def report_with(final: str, extra=()) -> str:
    return fx.duckdb_with(*SEARCH_VIEWS, "captures", "pdf_capture_pages",
                          ctes=search_ctes("fused") + resolve_ctes() + [REPORT_CTE, *extra]) + final


REPORT_CTE = ("rrows", """SELECT f.query_id, f.rank, coalesce(f.title, '') AS title, coalesce(f.href, '') AS url,
  coalesce(f.body, '') AS snippet, coalesce(f.source, '') AS source, f.published_us,
  CAST(coalesce(r.status, 0) AS INT) AS status, r.method AS fetch_method, false AS cached,
  CAST(coalesce(r.content_length, 0) AS BIGINT) AS content_length, coalesce(r.content, '') AS content, r.error
FROM fused f LEFT JOIN resolved r ON r.url = f.href""")

QSTATUS_CTE = ("qstatus", """SELECT q.query_id, CASE WHEN f.query_id IS NOT NULL THEN 'ok'
  WHEN b.query_id IS NOT NULL THEN 'error' ELSE 'empty' END AS status
FROM (SELECT DISTINCT query_id FROM source_outcomes) q
LEFT JOIN (SELECT DISTINCT query_id FROM fused) f ON f.query_id = q.query_id
LEFT JOIN (SELECT DISTINCT query_id FROM source_outcomes WHERE outcome <> 'ok') b ON b.query_id = q.query_id""")


@register("report_rows", report_with("SELECT * FROM rrows"))
def q_report_rows(spark, sf):
    return rows(Ctx(spark, sf))


@register("report_nested", report_with(f"""
SELECT q.query_id, coalesce(r.num_results, 0) AS num_results, coalesce(r.urls, '') AS urls, coalesce(u.sources_used, '') AS sources_used
FROM search_requests q LEFT JOIN
(SELECT query_id, count(*) AS num_results, string_agg(url, ' ' ORDER BY rank) AS urls FROM rrows GROUP BY query_id) r ON r.query_id = q.query_id
LEFT JOIN (SELECT query_id, string_agg(source, ',' ORDER BY array_position({list(REQUESTED)}, source)) AS sources_used
           FROM source_outcomes WHERE outcome = 'ok' GROUP BY query_id) u ON u.query_id = q.query_id"""))
def q_report_nested(spark, sf):
    c = Ctx(spark, sf)
    nested = RE.report_nested(rows(c), FU.sources_used(c.v("source_outcomes"), REQUESTED), queries=c.v("search_requests"))
    return nested.select("query_id", "num_results", F.array_join(F.transform("sources", lambda x: x["url"]), " ").alias("urls"),
                         F.coalesce("sources_used", F.lit("")).alias("sources_used"))


_DOMAIN_SRC = "SELECT url FROM pg UNION ALL SELECT coalesce(href, url) AS url FROM raw_b"


@register("result_domain", fx.duckdb_with("pg", "raw_b") + f"SELECT url, domain FROM ({X.domain_rel(_DOMAIN_SRC, 'url')}) z")
def q_result_domain(spark, sf):
    c = Ctx(spark, sf)
    urls = c.v("pg").select("url").unionByName(c.v("raw_b").select(F.coalesce("href", "url").alias("url")))
    return RE.with_domain(urls, "url")


@register("scrape_scorecard", report_with("""
SELECT q.queries_ok, q.queries_total, p.pages_ok, p.pages_total,
       CASE WHEN p.pages_total > 0 THEN round(100.0 * p.pages_ok / p.pages_total, 1) ELSE 0.0 END AS success_pct
FROM (SELECT count(*) FILTER (WHERE status <> 'error') AS queries_ok, count(*) AS queries_total FROM qstatus) q,
     (SELECT count(*) FILTER (WHERE status = 200 AND content <> '') AS pages_ok, count(*) AS pages_total FROM rrows) p""",
                                      extra=[QSTATUS_CTE]))
def q_scrape_scorecard(spark, sf):
    c = Ctx(spark, sf)
    fused = fused_once(c)
    status = FU.all_failed(fused, c.v("source_outcomes"))
    return RE.scrape_scorecard(rows(c, fused), status)


@register("error_breakdown", report_with(
    "SELECT error, count(*) AS n FROM rrows WHERE error IS NOT NULL OR content = '' GROUP BY error"))
def q_error_breakdown(spark, sf):
    return RE.error_breakdown(rows(Ctx(spark, sf)))


def _serp_with(*ctes, final: str) -> str:
    return fx.duckdb_with("serp_big", ctes=list(ctes)) + final


@register("coverage", _serp_with(*serp_ctes("200"), ("dom", X.domain_rel("SELECT * FROM fused", "href", "d")), final="""
SELECT q.queries_total, q.queries_ok, q.results_total, d.unique_domains,
       q.results_total >= 180 AND d.unique_domains >= 100 AS passed
FROM (SELECT count(*) AS queries_total, count(*) FILTER (WHERE n >= 20) AS queries_ok, CAST(coalesce(sum(n), 0) AS BIGINT) AS results_total
      FROM (SELECT query_id, count(*) AS n FROM fused GROUP BY query_id) c) q,
     (SELECT count(DISTINCT d) AS unique_domains FROM dom) d"""))
def q_coverage(spark, sf):
    return RE.coverage(serp_fused(spark, sf, n=200))


@register("scaling_check", _serp_with(*serp_ctes("200"), final="""
SELECT query_id, count(*) FILTER (WHERE rank <= 20) AS n_small, count(*) AS n_big,
       count(*) > count(*) FILTER (WHERE rank <= 20) AS scaled
FROM fused GROUP BY query_id"""))
def q_scaling_check(spark, sf):
    big = serp_fused(spark, sf, n=200)        # its first 20 ranks are the small run
    return RE.scaling_check(big.filter("rank <= 20"), big)


@register("result_set_diff", _serp_with(*serp_ctes("20"), *serp_ctes("20", REVERSED, "_r"), final="""
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.rank, b.rank) AS rank, a.href AS href_a, b.href AS href_b
FROM fused a FULL OUTER JOIN fused_r b ON a.query_id = b.query_id AND a.rank = b.rank
WHERE a.href IS DISTINCT FROM b.href"""))
def q_result_set_diff(spark, sf):
    return RE.result_set_diff(serp_fused(spark, sf, n=20), serp_fused(spark, sf, n=20, params=REVERSED))


@register("result_set_changes", _serp_with(*serp_ctes("20"), *serp_ctes("20", REVERSED, "_r"), final="""
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.href, b.href) AS href, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b
FROM (SELECT query_id, href, count(*) AS n FROM fused GROUP BY query_id, href) a
FULL OUTER JOIN (SELECT query_id, href, count(*) AS n FROM fused_r GROUP BY query_id, href) b ON a.query_id = b.query_id AND a.href IS NOT DISTINCT FROM b.href
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""))
def q_result_set_changes(spark, sf):
    return RE.result_set_changes(serp_fused(spark, sf, n=20), serp_fused(spark, sf, n=20, params=REVERSED))


# ---- the search call behind its memo -------------------------------------------

def _search_memo_sql(final: str) -> str:
    return fx.duckdb_with(*SEARCH_VIEWS, ctes=search_ctes("fused") + [
        QSTATUS_CTE, ("asked", "SELECT q.*, query_id LIKE 'en%' AS hit FROM search_requests q"),
        ("used", f"""SELECT query_id, string_agg(source, ',' ORDER BY array_position({list(REQUESTED)}, source)) AS used
FROM source_outcomes WHERE outcome = 'ok' GROUP BY query_id""")]) + final


def search_memo(c: Ctx, fused):
    """Earlier result sets: of the English queries (fresh) and the Spanish ones (expired), with three rows each."""
    from fanin.operators import memo as ME
    from fanin.plans.q_search import PARAMS
    kept = c.v("search_requests").filter("query_id LIKE 'en%' OR query_id LIKE 'es%'")
    sets = ME.result_sets(fused.filter("rank <= 3"), kept, FU.sources_used(c.v("source_outcomes"), REQUESTED))
    age = F.when(F.col("query_id").startswith("en"), SEARCH_TTL_S).otherwise(SEARCH_TTL_S + 1)
    return (sets.join(kept, "query_id").select(ME.search_key("query_id", "num_results", "time_range", PARAMS.sources).alias("key"),
                                               (F.lit(fx.SEARCH_AS_OF_US) - age * 1_000_000).cast("bigint").alias("ts_us"), "results", "sources_used"))


def search_cached(c: Ctx):
    from fanin import api
    from fanin.plans.q_search import PAGING, PARAMS, pages_a
    memo = search_memo(c, fused_once(c))
    return api.search_cached(pages_a(c), c.v("raw_b"), c.v("search_requests"), memo, fx.SEARCH_AS_OF_US, c.v("source_outcomes"),
                             REQUESTED, params=PARAMS, paging=PAGING)


@register("search_cached", _search_memo_sql("""SELECT f.query_id, f.rank, f.title, f.href, f.body, f.source, f.published_us, a.hit AS cached
FROM fused f JOIN asked a ON a.query_id = f.query_id WHERE NOT a.hit OR f.rank <= 3"""))
def q_search_cached(spark, sf):
    return search_cached(Ctx(spark, sf))[0]


@register("search_cached_queries", _search_memo_sql("""SELECT a.query_id, a.hit AS cached,
  CASE WHEN NOT a.hit THEN coalesce(s.status, 'empty') WHEN f.n > 0 THEN 'ok' ELSE 'empty' END AS status, coalesce(u.used, '') AS sources_used,
  CAST(coalesce(CASE WHEN a.hit THEN least(f.n, 3) ELSE f.n END, 0) AS BIGINT) AS num_results
FROM asked a LEFT JOIN qstatus s ON s.query_id = a.query_id LEFT JOIN used u ON u.query_id = a.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM fused GROUP BY query_id) f ON f.query_id = a.query_id"""))
def q_search_cached_queries(spark, sf):
    return search_cached(Ctx(spark, sf))[1]


@register("search_memo_next", _search_memo_sql(f"""SELECT sha256(concat_ws('|', 'search', a.query_id, CAST(a.num_results AS VARCHAR), a.time_range, '{",".join(PARAMS.sources)}')) AS key,
  CAST({fx.SEARCH_AS_OF_US} - CASE WHEN a.hit THEN {SEARCH_TTL_S * 1_000_000} WHEN s.status = 'error' THEN {(SEARCH_TTL_S + 1) * 1_000_000} ELSE 0 END AS BIGINT) AS ts_us,
  CAST(coalesce(CASE WHEN a.hit OR s.status = 'error' THEN least(f.n, 3) ELSE f.n END, 0) AS INT) AS n_results, coalesce(u.used, '') AS sources_used
FROM asked a JOIN qstatus s ON s.query_id = a.query_id LEFT JOIN used u ON u.query_id = a.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM fused GROUP BY query_id) f ON f.query_id = a.query_id
WHERE s.status <> 'error' OR a.query_id LIKE 'en%' OR a.query_id LIKE 'es%'"""))
def q_search_memo_next(spark, sf):
    """Fresh sets stay, expired and missing ones are replaced by what was searched; an errored search leaves the old set."""
    return search_cached(Ctx(spark, sf))[2].select("key", "ts_us", F.size("results").alias("n_results"), "sources_used")


# ---- the whole research call: search, memo before work, resolve misses, report ----

def research(c: Ctx):
    """The bulk research call (``fanin.api.web_research``): fused results, memo split, only
    misses resolved from the captures, hits from the memo, report rows with ``cached``."""
    from fanin import api
    from fanin.plans.q_capture import P
    from fanin.plans.q_memo import AS_OF, TTL, memo_whole
    return api.web_research(searched(c), c.v("captures"), memo_whole(c), AS_OF,
                            pdf_pages=c.v("pdf_capture_pages"), ttl_s=TTL, params=P)


def _research_sql() -> str:
    from fanin.plans.q_memo import AS_OF, FMT, MAX_LEN, MK, TTL
    key = f"sha256(concat_ws('|', 'fetch', href, '{FMT}', '{MAX_LEN}'))"
    expired = f"({AS_OF} - coalesce(ts_us, 0) > {TTL * 1_000_000})"
    ctes = search_ctes("fused") + resolve_ctes() + [MK, ("wanted", f"SELECT DISTINCT href AS url, {key} AS key FROM fused"),
        ("hit", f"""SELECT w.url, m.status, m.content, m.content_length, m.method, m.error FROM wanted w JOIN (SELECT * FROM mk WHERE NOT {expired}) m ON m.key = w.key"""),
        ("pages", f"""SELECT url, status, content, content_length, method, error, false AS cached FROM resolved
WHERE url IN (SELECT url FROM wanted) AND url NOT IN (SELECT url FROM hit)
UNION ALL SELECT url, status, content, content_length, method, error, true FROM hit""")]
    return fx.duckdb_with(*SEARCH_VIEWS, "captures", "pdf_capture_pages", "memo", ctes=ctes) + """
SELECT f.query_id, f.rank, coalesce(f.title, '') AS title, coalesce(f.href, '') AS url, coalesce(f.body, '') AS snippet,
  coalesce(f.source, '') AS source, f.published_us, CAST(coalesce(p.status, 0) AS INT) AS status, p.method AS fetch_method,
  coalesce(p.cached, false) AS cached, CAST(coalesce(p.content_length, 0) AS BIGINT) AS content_length,
  coalesce(p.content, '') AS content, p.error
FROM fused f LEFT JOIN pages p ON p.url = f.href"""


@register("research_report", _research_sql())
def q_research_report(spark, sf):
    return research(Ctx(spark, sf))


# ---- the research call from raw requests (intake, search, memo, per-query lengths) ----

def _deep_research_sql() -> tuple[str, str]:
    from dataclasses import replace

    from fanin.params import MAX_CONTENT_LENGTH
    from fanin.plans.q_capture import P
    from fanin.plans.q_memo import AS_OF, MK, TTL
    from fanin.plans.q_search import _clamp_sql
    expired = f"({AS_OF} - coalesce(ts_us, 0) > {TTL * 1_000_000})"
    key = f"sha256(concat_ws('|', 'fetch', href, '{P.fmt}', CAST(ml AS VARCHAR)))"
    ctes = search_ctes("fused", AS_OF) + resolve_ctes(replace(P, max_len=MAX_CONTENT_LENGTH)) + [
        MK,
        ("lens", f"SELECT query_id, {_clamp_sql('max_content_length', 500, 500000, 20000, 20000)} AS ml FROM research_requests"),
        ("fq", "SELECT f.*, coalesce(l.ml, 20000) AS ml FROM fused f LEFT JOIN lens l USING (query_id)"),
        ("wanted", f"SELECT DISTINCT href AS url, ml, {key} AS key FROM fq"),
        ("hit", f"SELECT w.url, w.ml, m.status, m.content, m.content_length, m.method, m.error FROM wanted w JOIN (SELECT * FROM mk WHERE NOT {expired}) m ON m.key = w.key"),
        ("miss", "SELECT w.url, w.ml FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.url = w.url AND h.ml = w.ml)"),
        ("pages", """SELECT r.url, m.ml, r.status, substring(r.content, 1, m.ml) AS content,
  CAST(least(r.content_length, m.ml) AS BIGINT) AS content_length, r.method, r.error, false AS cached
FROM resolved r JOIN miss m ON m.url = r.url
UNION ALL SELECT url, ml, status, content, content_length, method, error, true
FROM hit"""),
    ]
    return fx.duckdb_with(*SEARCH_VIEWS, "captures", "pdf_capture_pages", "memo", "research_requests", ctes=ctes), """
SELECT f.query_id, f.rank, coalesce(f.title, '') AS title, coalesce(f.href, '') AS url, coalesce(f.body, '') AS snippet,
  coalesce(f.source, '') AS source, f.published_us, CAST(coalesce(p.status, 0) AS INT) AS status, p.method AS fetch_method,
  coalesce(p.cached, false) AS cached, CAST(coalesce(p.content_length, 0) AS BIGINT) AS content_length,
  coalesce(p.content, '') AS content, p.error
FROM fq f LEFT JOIN pages p ON p.url = f.href AND p.ml = f.ml"""


@register("deep_research", "".join(_deep_research_sql()))
def q_deep_research(spark, sf):
    """Raw requests -> validate, clamp -> search -> memo split -> misses resolved -> report rows."""
    from fanin import api
    from fanin.plans.q_capture import P
    from fanin.plans.q_memo import AS_OF, TTL, memo_whole
    from fanin.plans.q_search import PAGING, PARAMS, pages_a
    c = Ctx(spark, sf)
    return api.deep_research(c.v("research_requests"), pages_a(c), c.v("raw_b"), c.v("captures"), memo_whole(c), AS_OF,
                             outcomes=c.v("source_outcomes"), pdf_pages=c.v("pdf_capture_pages"), fusion=PARAMS,
                             resolve_params=P, paging=PAGING, ttl_s=TTL)


def _reports_sql() -> str:
    head, final = _deep_research_sql()
    return f"""{head.rstrip()},
drows AS ({final})
SELECT r.query_id, {X.strip("r.query")} AS query,
       CASE WHEN d.n > 0 THEN 'ok' WHEN b.failed IS NOT NULL THEN 'error' ELSE 'empty' END AS status,
       CASE WHEN d.n IS NULL AND b.failed IS NOT NULL THEN 'all search sources failed: ' || b.failed END AS error,
       coalesce(u.used, '') AS sources_used, coalesce(d.n, 0) AS num_results, coalesce(d.urls, '') AS urls
FROM research_requests r
LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(url, ' ' ORDER BY rank) AS urls FROM drows GROUP BY query_id) d ON d.query_id = r.query_id
LEFT JOIN (SELECT query_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS failed FROM source_outcomes WHERE outcome <> 'ok'
           GROUP BY query_id) b ON b.query_id = r.query_id
LEFT JOIN (SELECT query_id, string_agg(source, ',' ORDER BY array_position({list(REQUESTED)}, source)) AS used FROM source_outcomes
           WHERE outcome = 'ok' GROUP BY query_id) u ON u.query_id = r.query_id"""


@register("research_reports", _reports_sql())
def q_research_reports(spark, sf):
    """One row per raw request: status, error, sources used, count and URLs in rank order."""
    from fanin import api
    from fanin.plans.q_capture import P
    from fanin.plans.q_memo import AS_OF, TTL, memo_whole
    from fanin.plans.q_search import PAGING, PARAMS, pages_a
    c = Ctx(spark, sf)
    out = api.reports(c.v("research_requests"), pages_a(c), c.v("raw_b"), c.v("captures"), memo_whole(c), AS_OF,
                      c.v("source_outcomes"), REQUESTED, pdf_pages=c.v("pdf_capture_pages"), fusion=PARAMS,
                      resolve_params=P, paging=PAGING, ttl_s=TTL)
    return out.withColumn("urls", F.array_join(F.transform("sources", lambda x: x["url"]), " ")).drop("sources")


@register("memo_next", fx.duckdb_with("captures", "pdf_capture_pages", "memo", ctes=resolve_ctes() + [
    ("mk", "SELECT sha256(concat_ws('|', 'fetch', url, fmt, CAST(max_len AS VARCHAR))) AS key, ts_us, status, content_length, method FROM memo"),
    ("fresh", """SELECT sha256(concat_ws('|', 'fetch', url, 'markdown', '20000')) AS key, CAST(1705276800000001 AS BIGINT) AS ts_us,
  status, content_length, method FROM resolved WHERE status = 200 AND content <> ''""")]) + """
SELECT * FROM fresh UNION ALL SELECT * FROM mk WHERE key NOT IN (SELECT key FROM fresh)""")
def q_memo_next(spark, sf):
    """The fetch memo after a scrape of all captures."""
    from fanin import api
    from fanin.plans.q_capture import P, resolved
    from fanin.plans.q_memo import AS_OF, memo_whole
    c = Ctx(spark, sf)
    return api.remember(memo_whole(c), resolved(c), AS_OF + 1, P).select("key", "ts_us", "status", "content_length", "method")


def _scrape_requests_sql() -> str:
    from dataclasses import replace

    from fanin.plans.q_capture import P
    from fanin.plans.q_search import _clamp_sql
    ask = (f"SELECT request_id, url, CASE WHEN lower({X.strip('format')}) = 'text' THEN 'text' ELSE 'markdown' END AS fmt, "
           f"CASE WHEN lower({X.strip('js_render')}) = 'always' THEN 'always' ELSE 'auto' END AS js, "
           f"{_clamp_sql('max_content_length', 500, 500000, 20000, 20000)} AS ml FROM scrape_asks")
    parts = []
    for f in ("markdown", "text"):
        for j in ("auto", "always"):
            ctes = resolve_ctes(replace(P, fmt=f, js_render=j, max_len=0))
            parts.append("SELECT * FROM (" + fx.duckdb_with("captures", "pdf_capture_pages", "scrape_asks", ctes=ctes) + f"""
SELECT a.request_id, a.url, CAST(coalesce(r.status, 0) AS INT) AS status, coalesce(r.title, '') AS title,
  coalesce(substring(r.content, 1, a.ml), '') AS content, CAST(coalesce(least(r.content_length, a.ml), 0) AS BIGINT) AS content_length,
  coalesce(r.method, 'unknown') AS method, coalesce(r.error, CASE WHEN r.url IS NULL THEN 'empty content' END) AS error
FROM ({ask}) a LEFT JOIN resolved r ON r.url = a.url WHERE trim(a.url) <> '' AND a.fmt = '{f}' AND a.js = '{j}')""")
    blank = ("SELECT * FROM (" + fx.duckdb_with("scrape_asks") + """
SELECT request_id, url, 0 AS status, '' AS title, '' AS content, CAST(0 AS BIGINT) AS content_length, 'unknown' AS method,
  'url must be a non-empty string' AS error FROM scrape_asks WHERE trim(url) = '')""")
    return " UNION ALL ".join([*parts, blank])


@register("scrape_requests", _scrape_requests_sql())
def q_scrape_requests(spark, sf):
    """One row per scrape request, each with its own format, length and rendering mode."""
    from fanin import api
    c = Ctx(spark, sf)
    return api.scrape_requests(c.v("scrape_asks"), c.v("captures"), c.v("pdf_capture_pages"))
