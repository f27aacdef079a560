"""Registered queries for capture routing, resolution and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanin.functions import html as H
from fanin.functions.urls import pdf_title
from fanin.operators import capture as CA
from fanin.operators import extract as EX
from fanin.plans import sqlx as X
from fanin.plans.q_search import Ctx
from fanin.plans.registry import register
from fanin.sources import fixtures as fx

P = CA.ResolveParams()


def resolved(c: Ctx):
    """The bulk scrape call (``fanin.api.scrape``) over the fixture captures."""
    from fanin import api
    return api.scrape(c.v("captures"), c.v("pdf_capture_pages"), P)


# ---- DuckDB: the same resolution as CTEs --------------------------------------

def resolve_ctes(p: CA.ResolveParams = P) -> list[tuple[str, str]]:
    force = "true" if p.js_render == "always" else "false"
    js_ok = "false" if p.js_render == "never" else "true"
    m = p.max_len
    sub = (lambda x: f"substring({x}, 1, {m})") if m > 0 else (lambda x: x)
    lst = (lambda x: f"least({x}, {m})") if m > 0 else (lambda x: x)
    ext = X.extract_expr("html", markdown=True, text_mode=(p.fmt == "text"))
    return [
        ("feat", f"""SELECT url, tier, status, error,
  (contains(lower(coalesce(content_type, '')), 'pdf') OR coalesce(starts_with(html, '%PDF'), false)) AS sniffed,
  CASE WHEN status = 200 THEN {ext} ELSE '' END AS cfull,
  CASE WHEN status = 200 THEN {X.dom_title('html')} END AS dom_title,
  CASE WHEN status = 200 THEN {X.meta_title('html')} END AS meta_title
FROM (SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY url, tier
      ORDER BY coalesce(status = 200, false) DESC, captured_at DESC NULLS LAST) = 1) best"""),
        ("pdft", f"""SELECT url, string_agg(text, chr(10) || chr(10) ORDER BY page_no, text) AS text FROM pdf_capture_pages
WHERE {X.strip("coalesce(text, '')")} <> '' GROUP BY url"""),
        ("urls", "SELECT url FROM captures UNION SELECT url FROM pdf_capture_pages"),
        ("j0", """SELECT u.url, s.status AS s_status, s.error AS s_error, coalesce(s.sniffed, false) AS s_sniffed,
  s.cfull AS s_c, s.dom_title AS s_dt, s.meta_title AS s_mt, s.url IS NOT NULL AS has_s,
  b.status AS b_status, b.cfull AS b_c, b.meta_title AS b_mt, b.url IS NOT NULL AS has_b, coalesce(p.text, '') AS text
FROM urls u LEFT JOIN feat s ON s.url = u.url AND s.tier = 'static' LEFT JOIN feat b ON b.url = u.url AND b.tier = 'browser'
LEFT JOIN pdft p ON p.url = u.url"""),
        ("j1", X.path_rel("SELECT * FROM j0", "url", "upath")),
        ("j2", f"""SELECT *, {X.looks_like_pdf_expr('upath')} AS by_url, has_s AND s_status = 200 AND s_sniffed AS sniffed,
  CASE WHEN s_status = 200 THEN length(s_c) ELSE 0 END AS s_len,
  CASE WHEN s_status = 200 THEN coalesce(nullif(s_dt, ''), s_mt, '') ELSE '' END AS s_title,
  {X.pdf_title_expr('upath', 'url')} AS ptitle FROM j1"""),
        ("j3", f"SELECT *, coalesce(by_url OR sniffed, false) AS is_pdf, text <> '' AS has_text, ({force} OR s_len < {p.min_content}) AS need_js FROM j2"),
        ("j4", f"SELECT *, coalesce(need_js AND {js_ok} AND has_b AND b_status = 200 AND length(b_c) > s_len, false) AS b_wins FROM j3"),
        ("j5", """SELECT *, CASE WHEN b_wins THEN b_c WHEN s_status = 200 THEN s_c ELSE '' END AS hc,
  CASE WHEN b_wins THEN length(b_c) ELSE s_len END AS hfull FROM j4"""),
        ("resolved", f"""SELECT url,
  CAST(CASE WHEN is_pdf AND has_text THEN 200 WHEN is_pdf THEN coalesce(s_status, 0) WHEN b_wins THEN b_status ELSE coalesce(s_status, 0) END AS INT) AS status,
  CASE WHEN by_url THEN (CASE WHEN has_text THEN ptitle ELSE '' END) WHEN sniffed THEN ptitle
       WHEN b_wins AND s_title = '' THEN coalesce(b_mt, '') ELSE s_title END AS title,
  CASE WHEN is_pdf THEN {sub('text')} ELSE {sub('hc')} END AS content,
  CAST(CASE WHEN is_pdf THEN (CASE WHEN has_text THEN {lst('length(text)')} ELSE 0 END)
            WHEN hc <> '' THEN {lst('hfull')} ELSE 0 END AS BIGINT) AS content_length,
  CASE WHEN is_pdf THEN 'pdf' WHEN b_wins THEN 'browser' WHEN has_s THEN 'static' ELSE 'unknown' END AS method,
  CASE WHEN is_pdf AND has_text THEN NULL
       WHEN by_url THEN (CASE WHEN s_status = 200 THEN '{CA.NO_PDF_TEXT}' ELSE coalesce(nullif(s_error, ''), '{CA.PDF_FAILED}') END)
       WHEN sniffed THEN '{CA.NO_PDF_TEXT}' WHEN hc <> '' THEN NULL
       ELSE coalesce(nullif(s_error, ''), '{CA.EMPTY_CONTENT}') END AS error,
  NOT is_pdf AND need_js AND {js_ok} AS render_queued, s_status AS static_status, s_len AS static_len
FROM j5"""),
    ]


def resolve_sql(final: str) -> str:
    return fx.duckdb_with("captures", "pdf_capture_pages", ctes=resolve_ctes()) + final


RESOLVED_OUT = ["url", "status", "title", "content", "content_length", "method", "error"]


@register("route_pdf", fx.duckdb_with("captures", ctes=[("c", X.path_rel("SELECT * FROM captures", "url", "upath"))]) + f"""
SELECT url, tier, CASE WHEN {X.looks_like_pdf_expr('upath')} THEN 'pdf_url'
  WHEN contains(lower(coalesce(content_type, '')), 'pdf') OR coalesce(starts_with(html, '%PDF'), false) THEN 'pdf_sniffed'
  ELSE 'html' END AS route FROM c""")
def q_route_pdf(spark, sf):
    return CA.route(Ctx(spark, sf).v("captures")).select("url", "tier", "route")


@register("pdf_title", fx.duckdb_with("captures", ctes=[("c", X.path_rel("SELECT * FROM captures WHERE tier = 'static'", "url", "upath"))])
          + f"SELECT url, {X.pdf_title_expr('upath', 'url')} AS pdf_title FROM c")
def q_pdf_title(spark, sf):
    caps = Ctx(spark, sf).v("captures").filter(F.col("tier") == "static")
    return caps.select("url", pdf_title("url").alias("pdf_title"))


@register("render_queue", resolve_sql("SELECT url, static_status, static_len FROM resolved WHERE render_queued"))
def q_render_queue(spark, sf):
    return CA.render_queue(resolved(Ctx(spark, sf)))


@register("resolve_winner", resolve_sql("SELECT url, status, title, content, content_length, method, error FROM resolved"))
def q_resolve_winner(spark, sf):
    return resolved(Ctx(spark, sf)).select(*RESOLVED_OUT)


@register("capture_errors", resolve_sql("SELECT url, status, method, error FROM resolved WHERE content = ''"))
def q_capture_errors(spark, sf):
    return CA.capture_errors(resolved(Ctx(spark, sf)))


@register("title_cascade", resolve_sql("SELECT url, title FROM resolved"))
def q_title_cascade(spark, sf):
    return resolved(Ctx(spark, sf)).select("url", "title")


@register("extract_text", fx.duckdb_with("pg") + f"SELECT page_id, {X.extract_text('html')} AS text FROM pg")
def q_extract_text(spark, sf):
    return Ctx(spark, sf).v("pg").select("page_id", H.extract_text("html").alias("text"))


@register("extract_markdown", fx.duckdb_with("pg") + f"SELECT page_id, {X.extract_markdown('html')} AS markdown FROM pg")
def q_extract_markdown(spark, sf):
    return Ctx(spark, sf).v("pg").select("page_id", H.extract_markdown("html").alias("markdown"))


@register("markdown_to_text", fx.duckdb_with("pg") +
          f"SELECT page_id, {X.markdown_to_text(X.extract_markdown('html'))} AS text FROM pg")
def q_markdown_to_text(spark, sf):
    return Ctx(spark, sf).v("pg").select("page_id", H.markdown_to_text(H.extract_markdown("html")).alias("text"))


FORMS = """concat('<h2>', role, '</h2><ul><li><b>turn</b> <a href="/c/', conv_id, '?t=', turn, '&amp;v=1">', turn, '</a><ol start="', turn, '"><li>', text,
  '</li><li><code>', role, '</code></li></ol></li><li>last</ul><blockquote><p>', text, '</p><em>', role, '</em></blockquote><nav>a<nav>b</nav>c</nav>',
  '<table><tr><th>conv</th><th>text</th></tr><tr><td>', conv_id, '<td>', text, '</table><pre>  ', text, '</pre><i>open')"""


@register("markdown_forms", f"""SELECT conv_id, turn, {X.extract_markdown('html')} AS markdown, {X.extract_text('html')} AS text
FROM (SELECT conv_id, turn, {FORMS} AS html FROM conversations) f""")
def q_markdown_forms(spark, sf):
    """Row 27 over pages of every form: nested and numbered lists, links, quotes, tables, code, nested regions."""
    pages = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id", "turn", FORMS + " AS html")
    return pages.select("conv_id", "turn", H.extract_markdown("html").alias("markdown"), H.extract_text("html").alias("text"))


@register("page_metadata", fx.duckdb_with("captures") + f"""
SELECT url, tier, {X.meta_title('html')} AS title, {X.meta_field('html', 'author')} AS author,
       {X.meta_field('html', 'description')} AS description, {X.meta_field('html', 'sitename')} AS sitename,
       {X.meta_language('html')} AS language FROM captures""")
def q_page_metadata(spark, sf):
    return Ctx(spark, sf).v("captures").select("url", "tier", H.page_metadata("html").alias("m")).select(
        "url", "tier", "m.*")


@register("assemble_pages", fx.duckdb_with("pdf_pages") + f"""
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no, text) AS text, count(*) AS n_pages
FROM pdf_pages WHERE {X.strip("coalesce(text, '')")} <> '' GROUP BY doc_id""")
def q_assemble_pages(spark, sf):
    return EX.assemble_pages(Ctx(spark, sf).v("pdf_pages"), "doc_id")


_MAXLEN_SQL = "CASE doc_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 0 ELSE 5000 END"


@register("truncate_content", fx.duckdb_with() + f"""
SELECT doc_id, max_len, CASE WHEN max_len <= 0 THEN text ELSE substring(text, 1, max_len) END AS content,
       CAST(CASE WHEN max_len <= 0 THEN length(text) ELSE least(length(text), max_len) END AS BIGINT) AS content_length
FROM (SELECT doc_id, text, {_MAXLEN_SQL} AS max_len FROM documents) d""")
def q_truncate_content(spark, sf):
    docs = Ctx(spark, sf).v("documents").select("doc_id", "text", F.expr(_MAXLEN_SQL).alias("max_len"))
    return docs.select("doc_id", "max_len", EX.truncate("text", F.col("max_len")).alias("content"),
                       EX.content_length("text", F.col("max_len")).alias("content_length"))
