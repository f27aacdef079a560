"""Registered queries over the page corpus and the report sink."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fanin.functions.html import extract_text
from fanin.operators import boilerplate as BO
from fanin.operators import fuse as FU
from fanin.operators import report as RE
from fanin.operators import retrieve as RT
from fanin.plans import sqlx as X
from fanin.plans.q_report import rows
from fanin.plans.q_search import REQUESTED, Ctx
from fanin.plans.registry import ORACLES, register
from fanin.session import scratch_path
from fanin.sources import fixtures as fx
from fanin.sources.sinks import read_report_json, write_report_json

K = 20
BOILER_K = 3


def _queries(c: Ctx):
    return RT.query_terms(c.v("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), "text"),
                          "qid", "text")


def _retrieve_sql() -> str:
    tok = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), {X.lit(RT.TOKEN_RE)})"
    parts = []
    ctes = [("qt", f"""SELECT DISTINCT query_id, term FROM (
  SELECT 'b' || CAST(item_id AS VARCHAR) AS query_id, unnest({tok('text')}) AS term FROM benchmark) q""")]
    for src, text in (("a", "title"), ("b", X.extract_text("html"))):
        ctes += [
            (f"t_{src}", f"""SELECT term, doc_id, count(*) AS tf FROM (
  SELECT page_id AS doc_id, unnest({tok(text)}) AS term FROM pg) x GROUP BY term, doc_id"""),
            (f"r_{src}", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_terms DESC, hits DESC, doc_id) AS rn FROM (
  SELECT query_id, doc_id, count(*) AS n_terms, sum(tf) AS hits FROM qt JOIN t_{src} USING (term) GROUP BY query_id, doc_id) s"""),
        ]
        parts.append(f"""SELECT query_id, '{src}' AS source, CAST(rn - 1 AS INT) AS raw_rank, doc_id AS page_id, pg.url AS href,
  CAST(n_terms AS BIGINT) AS n_terms, CAST(hits AS BIGINT) AS hits FROM r_{src} JOIN pg ON pg.page_id = r_{src}.doc_id WHERE rn <= {K}""")
    return fx.duckdb_with("pg", ctes=ctes) + "\nUNION ALL\n".join(parts)


@register("retrieve_ranked", _retrieve_sql())
def q_retrieve_ranked(spark, sf):
    c = Ctx(spark, sf)
    pg, q = c.v("pg"), _queries(c)
    a = RT.retrieve_ranked(q, RT.postings(pg, "page_id", F.col("title")), K, "a")
    b = RT.retrieve_ranked(q, RT.postings(pg, "page_id", extract_text("html")), K, "b")
    urls = pg.select(F.col("page_id").alias("doc_id"), F.col("url").alias("href"))
    return (a.unionByName(b).join(urls, "doc_id")
            .select("query_id", "source", "raw_rank", F.col("doc_id").alias("page_id"), "href", "n_terms", "hits"))


def _boiler_sql() -> str:
    ctes = [
        ("d", X.domain_rel("SELECT page_id, url, html FROM pg", "url", "host")),
        ("pgx", f"SELECT page_id, host, {X.extract_text('html')} AS text FROM d"),
        ("bl", """SELECT page_id, host, generate_subscripts(l, 1) AS pos, unnest(l) AS block
FROM (SELECT page_id, host, string_split(text, chr(10)) AS l FROM pgx) s"""),
        ("nb", f"SELECT * FROM bl WHERE {X.strip('block')} <> ''"),
        ("boiler", f"SELECT host, block FROM nb GROUP BY host, block HAVING count(DISTINCT page_id) >= {BOILER_K}"),
        ("fl", """SELECT nb.*, b.block IS NOT NULL AS is_boiler FROM nb
LEFT JOIN boiler b ON b.host = nb.host AND b.block = nb.block"""),
        ("per", """SELECT page_id, count(*) AS n_blocks, count(*) FILTER (WHERE NOT is_boiler) AS n_kept,
  string_agg(block, chr(10) ORDER BY pos) FILTER (WHERE NOT is_boiler) AS main_text FROM fl GROUP BY page_id"""),
    ]
    return fx.duckdb_with("pg", ctes=ctes) + """SELECT p.page_id, p.host, coalesce(per.main_text, '') AS main_text,
  CAST(coalesce(per.n_blocks, 0) AS BIGINT) AS n_blocks, CAST(coalesce(per.n_kept, 0) AS BIGINT) AS n_kept
FROM pgx p LEFT JOIN per ON per.page_id = p.page_id"""


@register("host_boilerplate", _boiler_sql())
def q_host_boilerplate(spark, sf):
    return BO.host_boilerplate(Ctx(spark, sf).v("pg"), BOILER_K)


@register("report_sink", ORACLES["report_nested"])
def q_report_sink(spark, sf):
    """Write the nested reports as JSON (partitioned by run date), read them back."""
    c = Ctx(spark, sf)
    run_date = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=fx.SEARCH_AS_OF_US)).date().isoformat()
    nested = RE.report_nested(rows(c), FU.sources_used(c.v("source_outcomes"), REQUESTED), queries=c.v("search_requests")).withColumn(
        "run_date", F.lit(run_date))
    path = scratch_path(spark, "reports")
    write_report_json(nested, path, ("run_date",))
    back = read_report_json(spark, path, nested.schema)
    return back.select("query_id", "num_results", F.array_join(F.transform("sources", lambda x: x["url"]), " ").alias("urls"),
                       F.coalesce("sources_used", F.lit("")).alias("sources_used"))
