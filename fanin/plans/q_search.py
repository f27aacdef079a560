"""Registered queries for scans, intake, normalisation and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanin.operators import fuse as FU
from fanin.operators import intake as IN
from fanin.operators import normalise as NO
from fanin.params import MAX_PAGES, SOURCE_B_MAX, FusionParams, PagingParams
from fanin.plans import sqlx as X
from fanin.plans.registry import register
from fanin.session import scratch_path
from fanin.sources import fixtures as fx
from fanin.sources.tables import conform_captures, flatten_pages, read_captures, read_result_pages

PER_PAGE = 5                      # raw_a holds 5 items per page
REQUESTED = ("a", "b", "unlisted")  # the order the sources were asked in
PARAMS = FusionParams(sources=("a", "b"))
PAGING = PagingParams(PER_PAGE, MAX_PAGES, SOURCE_B_MAX)   # the limits of a live call, as rows 7, 8 and 10 have them
SERP_N = 20


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

class Ctx:
    """Views of one (session, sf_dir), built once per query."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self.memo = spark, sf, {}

    def v(self, name: str) -> DataFrame:
        return fx.view(self.spark, self.sf, name, self.memo)


def pages_a(c: Ctx) -> DataFrame:
    """Source A as recorded pages (one row per query and page, items in order)."""
    raw = c.v("raw_a")
    item = F.struct("pos", "url", "title", "content", "score", "published_us")
    pages = raw.groupBy("query_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return pages.select("query_id", F.lit("a").alias("source"), "page_no",
                        F.transform("_items", lambda x: F.struct(
                            x["url"].alias("url"), x["title"].alias("title"), x["content"].alias("content"),
                            F.array().cast("array<string>").alias("engines"), x["score"].alias("score"),
                            x["published_us"].alias("published_us"))).alias("items"))


def items_a(c: Ctx) -> DataFrame:
    return flatten_pages(pages_a(c))


def recorded(c: Ctx, df: DataFrame, label: str) -> str:
    """The path of ``df`` as a recording: a Parquet folder under the session's shared folder."""
    path = scratch_path(c.spark, label)
    df.write.parquet(path)
    return path


def in_range(c: Ctx, items: DataFrame) -> DataFrame:
    return IN.time_range_filter(items, c.v("search_requests"), fx.SEARCH_AS_OF_US)


def kept_a(c: Ctx) -> DataFrame:
    return IN.page_early_stop(in_range(c, items_a(c)), c.v("search_requests"), per_page=PER_PAGE)


def normalised(c: Ctx) -> DataFrame:
    req = c.v("search_requests")
    return NO.union_sources(NO.normalise_a(kept_a(c), req), NO.normalise_b(in_range(c, c.v("raw_b")), req, source_max=SOURCE_B_MAX))


def searched(c: Ctx) -> DataFrame:
    """The bulk search call (``fanin.api.search_urls``) over the fixture sources."""
    from fanin import api
    return api.search_urls(pages_a(c), c.v("raw_b"), c.v("search_requests"), fx.SEARCH_AS_OF_US,
                           outcomes=c.v("source_outcomes"), params=PARAMS, paging=PAGING)


RESULT_OUT = ["query_id", "source", "raw_rank", "href", "title", "body", "score", "published_us"]


# ---------------------------------------------------------------------------
# DuckDB side: the same chain as CTEs
# ---------------------------------------------------------------------------

def _cutoff_case(pub: str, tr: str, as_of_us: int = fx.SEARCH_AS_OF_US) -> str:
    cut = IN.time_range_cutoffs(as_of_us)
    whens = " ".join(f"WHEN '{k}' THEN {pub} >= {v}" for k, v in cut.items())
    return f"coalesce(CASE {tr} WHEN '' THEN true {whens} ELSE false END, false)"


def _sc(col: str) -> str:
    """``(col or '').strip()``"""
    return X.strip(f"coalesce({col}, '')")


def norm_a_sql(src: str) -> str:
    x = (f"SELECT query_id, raw_pos, {_sc('url')} AS href, {_sc('title')} AS title, "
         f"{_sc('content')} AS body, coalesce(CAST(score AS DOUBLE), 0.0) AS score, published_us FROM {src}")
    d = f"SELECT * FROM ({x}) x WHERE href <> '' QUALIFY row_number() OVER (PARTITION BY query_id, href ORDER BY raw_pos) = 1"
    r = (f"SELECT d.*, row_number() OVER (PARTITION BY d.query_id ORDER BY raw_pos) AS rn, q.num_results "
         f"FROM ({d}) d JOIN search_requests q USING (query_id)")
    return (f"SELECT query_id, 'a' AS source, CAST(rn - 1 AS INT) AS raw_rank, href, title, body, score, published_us "
            f"FROM ({r}) r WHERE rn <= num_results")


def norm_b_sql() -> str:
    href = X.strip("coalesce(nullif(href, ''), nullif(url, ''), '')")
    x = (f"SELECT query_id, pos, {href} AS href, {_sc('title')} AS title, "
         f"{_sc('body')} AS body, published_us FROM b_items")
    r = (f"SELECT x.*, row_number() OVER (PARTITION BY x.query_id ORDER BY pos) AS rn, q.num_results "
         f"FROM ({x}) x JOIN search_requests q USING (query_id) WHERE href <> ''")
    return (f"SELECT query_id, 'b' AS source, CAST(rn - 1 AS INT) AS raw_rank, href, title, body, CAST(1.0 AS DOUBLE) AS score, "
            f"published_us FROM ({r}) r WHERE rn <= least(num_results, 100)")


def search_ctes(upto: str, as_of_us: int = fx.SEARCH_AS_OF_US) -> list[tuple[str, str]]:
    ctes = [
        ("a_items", "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY page_no, pos) AS BIGINT) AS raw_pos FROM raw_a"),
        ("a_range", f"SELECT u.* FROM a_items u JOIN search_requests r USING (query_id) WHERE {_cutoff_case('u.published_us', 'r.time_range', as_of_us)}"),
        ("b_items", f"SELECT u.* FROM raw_b u JOIN search_requests r USING (query_id) WHERE {_cutoff_case('u.published_us', 'r.time_range', as_of_us)}"),
        ("budget", f"SELECT query_id, num_results, time_range, CAST(least(greatest(ceil(num_results / {PER_PAGE}.0), 1), 10) AS INT) AS pages FROM search_requests"),
        ("a_budget", "SELECT i.* FROM a_items i JOIN budget b USING (query_id) WHERE i.page_no <= b.pages"),
        ("allp", "SELECT query_id, CAST(unnest(range(1, pages + 1)) AS INT) AS page_no FROM budget"),
        ("cnt", "SELECT query_id, page_no, count(*) AS n FROM a_range GROUP BY query_id, page_no"),
        ("pb", "SELECT p.query_id, floor(p.page_no / 2) AS batch, sum(coalesce(c.n, 0)) AS n FROM allp p "
               "LEFT JOIN cnt c ON c.query_id = p.query_id AND c.page_no = p.page_no GROUP BY p.query_id, floor(p.page_no / 2)"),
        ("stopq", "SELECT query_id, min(batch) AS stop FROM pb WHERE batch >= 1 AND n = 0 GROUP BY query_id"),
        ("a_kept", "SELECT i.* FROM a_range i JOIN budget b USING (query_id) LEFT JOIN stopq s USING (query_id) "
                   "WHERE i.page_no <= b.pages AND floor(i.page_no / 2) <= coalesce(s.stop, 10)"),
        ("norm_a", norm_a_sql("a_kept")),
        ("norm_b", norm_b_sql()),
        ("unioned", "SELECT * FROM norm_a UNION ALL SELECT * FROM norm_b"),
        ("oksrc", "SELECT u.* FROM unioned u WHERE EXISTS (SELECT 1 FROM source_outcomes o WHERE o.query_id = u.query_id "
                  "AND o.source = u.source AND o.outcome = 'ok')"),
    ]
    ctes += fusion_ctes("oksrc", "n_req")
    names = [n for n, _ in ctes]
    return ctes[: names.index(upto) + 1]


def fusion_ctes(src: str, n: str, params: FusionParams = PARAMS, sfx: str = "") -> list[tuple[str, str]]:
    """Priority, canonical URL, dedupe, interleave as CTEs named prio{sfx} ... fused{sfx}.

    ``n``: 'n_req' (each query's num_results) or a number."""
    prio = " ".join(f"WHEN '{s}' THEN {i}" for s, i in params.priority_pairs())
    listed = ", ".join(f"'{s}'" for s in params.sources)
    limit = ("JOIN search_requests q USING (query_id) WHERE rank <= q.num_results" if n == "n_req"
             else f"WHERE rank <= {n}")
    return [
        (f"prio{sfx}", f"SELECT *, CAST(CASE source {prio} END AS INT) AS priority FROM {src} WHERE source IN ({listed})"),
        (f"canon{sfx}", X.canonical_rel(f"SELECT * FROM prio{sfx}", "href")),
        (f"dedup{sfx}", f"SELECT * FROM canon{sfx} QUALIFY row_number() OVER (PARTITION BY query_id, canonical_url ORDER BY raw_rank, priority) = 1"),
        (f"ranked{sfx}", f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw_rank, priority) AS BIGINT) AS rank FROM dedup{sfx}"),
        (f"fused{sfx}", f"SELECT r.* FROM ranked{sfx} r {limit}"),
    ]


SEARCH_VIEWS = ("raw_a", "raw_b", "search_requests", "source_outcomes")


def search_sql(upto: str, final: str) -> str:
    return fx.duckdb_with(*SEARCH_VIEWS, ctes=search_ctes(upto)) + final


# ---------------------------------------------------------------------------
# Registered queries
# ---------------------------------------------------------------------------

@register("scan_results", search_sql("a_items", "SELECT query_id, page_no, pos, raw_pos, url, title FROM a_items"))
def q_scan_results(spark, sf):
    c = Ctx(spark, sf)
    pages = read_result_pages(spark, recorded(c, pages_a(c), "result-pages"))
    return flatten_pages(pages).select("query_id", "page_no", "pos", "raw_pos", "url", "title")


@register("scan_captures", fx.duckdb_with("captures") +
          "SELECT url, tier, status, lower(content_type) AS content_type, CAST(length(html) AS BIGINT) AS html_chars, "
          "CAST(NULL AS BLOB) IS NULL AS no_body FROM captures")
def q_scan_captures(spark, sf):
    c = Ctx(spark, sf)
    caps = read_captures(spark, recorded(c, conform_captures(c.v("captures")), "captures"))
    return caps.select("url", "tier", "status", F.lower("content_type").alias("content_type"),
                       F.length("html").cast("bigint").alias("html_chars"), F.col("body").isNull().alias("no_body"))


@register("intake_validate", fx.duckdb_with("requests") + f"""
SELECT query_id, query, time_range, reject_reason, reject_reason IS NULL AS accepted FROM (
  SELECT query_id, q AS query, tr AS time_range,
         CASE WHEN q = '' THEN {X.lit(IN.QUERY_ERROR)}
              WHEN tr NOT IN ('', 'd', 'w', 'm', 'y') THEN {X.lit(IN.TIME_RANGE_ERROR)} END AS reject_reason
  FROM (SELECT query_id, {X.strip("coalesce(query, '')")} AS q, lower({X.strip("coalesce(time_range, '')")}) AS tr FROM requests) s) t""")
def q_intake_validate(spark, sf):
    return IN.validate(Ctx(spark, sf).v("requests")).select("query_id", "query", "time_range", "reject_reason", "accepted")


def _clamp_sql(col: str, lo: int, hi: int, invalid: int, absent: int) -> str:
    s = X.strip(col)
    return (f"CASE WHEN {col} IS NULL THEN {absent} "
            f"WHEN regexp_matches({s}, {X.lit(IN.NUMBER_RE)}) THEN CAST(floor(least(greatest(TRY_CAST({s} AS DOUBLE), {lo}.0), {hi}.0)) AS INT) "
            f"ELSE {invalid} END")


@register("intake_clamp", fx.duckdb_with("requests") + f"""
SELECT query_id, {_clamp_sql('num_results', 1, 200, 15, 15)} AS num_results,
       {_clamp_sql('max_content_length', 500, 500000, 20000, 20000)} AS max_content_length,
       {_clamp_sql('num_results', 1, 200, 15, 20)} AS num_results_search
FROM requests""")
def q_intake_clamp(spark, sf):
    req = Ctx(spark, sf).v("requests")
    both = IN.clamp(req.withColumn("_n", F.col("num_results")), "research")
    search = IN.clamp_number(F.col("_n"), 1, IN.MAX_NUM_RESULTS, IN.DEFAULT_NUM_RESULTS, IN.DEFAULT_SEARCH_NUM_RESULTS)
    return both.select("query_id", "num_results", "max_content_length", search.alias("num_results_search"))


@register("page_budget", search_sql("a_budget", "SELECT query_id, page_no, pos, raw_pos, url FROM a_budget"))
def q_page_budget(spark, sf):
    c = Ctx(spark, sf)
    return IN.page_budget(items_a(c), c.v("search_requests"), per_page=PER_PAGE).select(
        "query_id", "page_no", "pos", "raw_pos", "url")


@register("page_early_stop", search_sql("a_kept", "SELECT query_id, page_no, pos, raw_pos, url FROM a_kept"))
def q_page_early_stop(spark, sf):
    return kept_a(Ctx(spark, sf)).select("query_id", "page_no", "pos", "raw_pos", "url")


@register("normalise_a", search_sql("norm_a", "SELECT * FROM norm_a"))
def q_normalise_a(spark, sf):
    c = Ctx(spark, sf)
    return NO.normalise_a(kept_a(c), c.v("search_requests")).select(*RESULT_OUT)


@register("normalise_b", search_sql("norm_b", "SELECT * FROM norm_b"))
def q_normalise_b(spark, sf):
    c = Ctx(spark, sf)
    return NO.normalise_b(in_range(c, c.v("raw_b")), c.v("search_requests"), source_max=SOURCE_B_MAX).select(*RESULT_OUT)


@register("union_sources", search_sql("unioned", "SELECT * FROM unioned"))
def q_union_sources(spark, sf):
    return normalised(Ctx(spark, sf)).select(*RESULT_OUT)


@register("time_range_filter", search_sql("b_items", """
SELECT query_id, 'a' AS source, CAST(raw_pos AS INT) AS at, url, published_us FROM a_range
UNION ALL SELECT query_id, 'b', pos, coalesce(href, url), published_us FROM b_items"""))
def q_time_range_filter(spark, sf):
    c = Ctx(spark, sf)
    a = items_a(c).select("query_id", F.lit("a").alias("source"), F.col("raw_pos").cast("int").alias("at"), "url", "published_us")
    b = c.v("raw_b").select("query_id", F.lit("b").alias("source"), F.col("pos").alias("at"), F.coalesce("href", "url").alias("url"),
                            "published_us")
    return in_range(c, a.unionByName(b))


_URLS_SQL = ("SELECT url FROM pg UNION ALL SELECT url FROM raw_a UNION ALL SELECT coalesce(href, url) AS url FROM raw_b")


@register("canonical_url", fx.duckdb_with("pg", "raw_a", "raw_b") +
          f"SELECT url, canonical_url FROM ({X.canonical_rel(_URLS_SQL, 'url')}) z")
def q_canonical_url(spark, sf):
    c = Ctx(spark, sf)
    urls = (c.v("pg").select("url").unionByName(c.v("raw_a").select("url"))
            .unionByName(c.v("raw_b").select(F.coalesce("href", "url").alias("url"))))
    return FU.with_canonical(urls, "url")


@register("source_priority", fx.duckdb_with("serp_outcomes") +
          "SELECT query_id, source, outcome, CAST(CASE source WHEN 'a' THEN 0 WHEN 'b' THEN 1 END AS INT) AS priority "
          "FROM serp_outcomes WHERE source IN ('a', 'b')")
def q_source_priority(spark, sf):
    return FU.source_priority(Ctx(spark, sf).v("serp_outcomes"), PARAMS)


@register("fuse_dedupe", search_sql("dedup", "SELECT query_id, source, raw_rank, href, canonical_url, priority FROM dedup"))
def q_fuse_dedupe(spark, sf):
    c = Ctx(spark, sf)
    df = FU.drop_failed_sources(normalised(c), c.v("source_outcomes"))
    return FU.fuse_dedupe(FU.with_canonical(FU.source_priority(df, PARAMS))).select(
        "query_id", "source", "raw_rank", "href", "canonical_url", "priority")


@register("search_urls", search_sql("fused", "SELECT query_id, rank, source, raw_rank, href, title, body FROM fused"))
def q_search_urls(spark, sf):
    return searched(Ctx(spark, sf)).select("query_id", "rank", "source", "raw_rank", "href", "title", "body")


@register("sources_used", fx.duckdb_with("serp_outcomes") + """
SELECT query_id,
       coalesce(string_agg(source, ',' ORDER BY array_position(['a', 'b', 'unlisted'], source)) FILTER (WHERE outcome = 'ok'), '') AS sources_used,
       coalesce(string_agg(source, ',' ORDER BY array_position(['a', 'b', 'unlisted'], source)) FILTER (WHERE outcome <> 'ok'), '') AS sources_failed
FROM serp_outcomes GROUP BY query_id""")
def q_sources_used(spark, sf):
    return FU.sources_used(Ctx(spark, sf).v("serp_outcomes"), REQUESTED)


# ---- fusion at bench scale over serp_big -----------------------------------

def serp_fused(spark, sf, n: int = SERP_N, params: FusionParams = PARAMS) -> DataFrame:
    return FU.fuse(Ctx(spark, sf).v("serp_big"), n=n, params=params)


def serp_sql(n: int, final: str, params: FusionParams = PARAMS) -> str:
    return fx.duckdb_with("serp_big", ctes=serp_ctes(str(n), params)) + final


def serp_ctes(n: str, params: FusionParams = PARAMS, sfx: str = "") -> list[tuple[str, str]]:
    """Fusion of serp_big as CTEs named prio{sfx} ... fused{sfx}."""
    return fusion_ctes("serp_big", n, params, sfx)


@register("fuse_interleave_topk", serp_sql(SERP_N, "SELECT query_id, rank, source, raw_rank, href FROM fused"))
def q_fuse_interleave_topk(spark, sf):
    return serp_fused(spark, sf).select("query_id", "rank", "source", "raw_rank", "href")


def _all_failed_sql() -> str:
    ctes = [("oksrc", "SELECT s.* FROM serp_big s WHERE EXISTS (SELECT 1 FROM serp_outcomes o WHERE o.query_id = s.query_id "
                      "AND o.source = s.source AND o.outcome = 'ok')")]
    ctes += [(n, q.replace("FROM serp_big", "FROM oksrc")) for n, q in serp_ctes(str(SERP_N))]
    return fx.duckdb_with("serp_big", "serp_outcomes", ctes=ctes) + """
SELECT q.query_id, CASE WHEN f.query_id IS NOT NULL THEN 'ok' WHEN b.failed IS NOT NULL THEN 'error' ELSE 'empty' END AS status,
       CASE WHEN f.query_id IS NULL AND b.failed IS NOT NULL THEN 'all search sources failed: ' || b.failed END AS error
FROM (SELECT DISTINCT query_id FROM serp_outcomes) q
LEFT JOIN (SELECT DISTINCT query_id FROM fused) f ON f.query_id = q.query_id
LEFT JOIN (SELECT query_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS failed FROM serp_outcomes
           WHERE outcome <> 'ok' GROUP BY query_id) b ON b.query_id = q.query_id"""


@register("all_failed", _all_failed_sql())
def q_all_failed(spark, sf):
    c = Ctx(spark, sf)
    outcomes = c.v("serp_outcomes")
    fused = FU.fuse(c.v("serp_big"), n=SERP_N, outcomes=outcomes, params=PARAMS)
    return FU.all_failed(fused, outcomes)
