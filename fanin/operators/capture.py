"""Capture routing and resolution.

A URL may have a static capture, a browser capture and extracted PDF pages.
All per-row work (route, extraction, lengths, titles) happens before the
shuffle, the wide ``html`` column is dropped there, and content is cut to
``max_len`` on the map side; one ``groupBy(url)`` then brings a URL's tiers
and PDF pages together and a ``when`` chain picks the winner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanin.functions import html as H
from fanin.functions.text import pystrip
from fanin.functions.urls import pdf_path, pdf_title_from_path, with_url_path
from fanin.operators.extract import content_length, truncate
from fanin.params import DEFAULT_MAX_CONTENT_LENGTH, FETCH_MIN_CONTENT
from fanin.sources.tables import conform_captures

PDF_MAGIC = b"%PDF"
NO_PDF_TEXT = "pdf produced no extractable text"
PDF_FAILED = "pdf extraction failed"
EMPTY_CONTENT = "empty content"


@dataclass(frozen=True)
class ResolveParams:
    fmt: str = "markdown"
    max_len: int = DEFAULT_MAX_CONTENT_LENGTH
    js_render: str = "auto"         # 'auto' | 'always' (force) | 'never'
    min_content: int = FETCH_MIN_CONTENT


def route(captures: DataFrame) -> DataFrame:
    """Row 19: ``route`` = 'pdf_url' (path ends .pdf / has ;.pdf), 'pdf_sniffed'
    (content type mentions pdf, or the body starts with %PDF) or 'html'."""
    c = conform_captures(captures)
    sniffed = (F.lower(F.coalesce(F.col("content_type"), F.lit(""))).contains("pdf")
               | F.coalesce(F.substring("body", 1, 4) == F.lit(PDF_MAGIC), F.lit(False))
               | F.coalesce(F.col("html").startswith("%PDF"), F.lit(False)))
    staged = with_url_path(c, "url", "_path")
    r = F.when(pdf_path(F.col("_path")), F.lit("pdf_url")).when(sniffed, F.lit("pdf_sniffed")).otherwise(F.lit("html"))
    return staged.withColumn("route", r).drop("_path")


def _features(captures: DataFrame, p: ResolveParams) -> DataFrame:
    """Map side: one narrow row per capture; ``html`` and ``body`` stop here.

    The extraction is projected once, then measured and cut in the next
    projection: to the capture's ``cut_len`` where it has one, else to ``max_len``
    (0 or less: whole).  ``_pref`` orders a URL's captures of one tier.
    """
    cut = F.coalesce(F.col("cut_len"), F.lit(p.max_len))
    r = route(captures)
    # a static capture routed to PDF is never read as HTML (its text comes from the PDF
    # pages), so the extraction is skipped for it
    ok = (F.col("status") == 200) & ~((F.col("tier") == "static") & (F.col("route") != "html"))
    staged = r.select(
        "url", "tier", "status", "error", (F.col("route") == "pdf_sniffed").alias("sniffed"),
        F.when(ok, H.extract_content("html", p.fmt)).otherwise(F.lit("")).alias("_c"),
        F.when(ok, H.dom_title("html")).alias("dom_title"), F.when(ok, H.meta_title("html")).alias("meta_title"),
        "captured_at", cut.alias("_cut"))
    sized = staged.select("*", F.length("_c").cast("bigint").alias("full_len"))
    f = F.struct("status", "error", "sniffed", "full_len", truncate("_c", F.col("_cut")).alias("content"), "dom_title", "meta_title")
    return sized.select("url", "tier", f.alias("f"), (F.col("status") == 200).alias("_good"), "captured_at").select(
        "url", "tier", "f", F.struct(F.coalesce("_good", F.lit(False)).alias("good"), "captured_at",
                                     F.col("f.full_len").alias("full_len"), "f").alias("_pref"))


def gather(captures: DataFrame, pdf_pages: DataFrame | None, p: ResolveParams) -> DataFrame:
    """One row per URL: static struct ``S``, browser struct ``B``, PDF page list ``P``.

    A single shuffle on ``url``; each list holds one document's pages.  Of several
    captures of a tier, status 200 goes before any other, then the latest one
    (``captured_at``), then the longest.
    """
    feats = _features(captures, p).withColumn("_kind", F.col("tier"))
    if pdf_pages is not None:
        pdf = pdf_pages.select("url", F.lit("pdf").alias("tier"),
                               F.struct(F.col("page_no").cast("int").alias("page_no"),
                                        F.col("text").alias("text")).alias("pg"))
        feats = feats.unionByName(pdf.withColumn("_kind", F.lit("pdf")), allowMissingColumns=True)
    else:
        feats = feats.withColumn("pg", F.lit(None).cast("struct<page_no:int,text:string>"))
    return feats.groupBy("url").agg(
        F.max(F.when(F.col("_kind") == "static", F.col("_pref")))["f"].alias("S"),
        F.max(F.when(F.col("_kind") == "browser", F.col("_pref")))["f"].alias("B"),
        F.array_sort(F.collect_list(F.when(F.col("_kind") == "pdf", F.col("pg")))).alias("P"))


def _pdf_text(P: Column) -> Column:
    kept = F.filter(P, lambda g: pystrip(F.coalesce(g["text"], F.lit(""))) != "")
    return F.array_join(F.transform(kept, lambda g: g["text"]), "\n\n")


def _decide(g: DataFrame, p: ResolveParams) -> DataFrame:
    """The reference's cascade as ``when`` chains.

    Intermediate values are projected once, in stages, so the URL split and
    the lengths are computed once per row (Catalyst does not collapse a
    projection whose costly expressions the next one uses twice).
    """
    S, B = F.col("S"), F.col("B")
    s_status = S["status"]
    g0 = with_url_path(g.select("url", "S", "B", _pdf_text(F.col("P")).alias("text")), "url", "_path")
    g1 = g0.select("url", "S", "B", "text", pdf_path(F.col("_path")).alias("by_url"),
                   pdf_title_from_path(F.col("_path"), F.col("url")).alias("ptitle"))
    g2 = g1.select(
        "*",
        S.isNotNull().alias("has_s"),
        (S.isNotNull() & (s_status == 200) & F.coalesce(S["sniffed"], F.lit(False))).alias("sniffed"),
        F.when(s_status == 200, S["full_len"]).otherwise(F.lit(0)).alias("s_len"),
        F.when(s_status == 200, F.coalesce(F.nullif(S["dom_title"], F.lit("")), S["meta_title"], F.lit("")))
        .otherwise(F.lit("")).alias("s_title"))
    need_js = F.lit(p.js_render == "always") | (F.col("s_len") < p.min_content)
    g3 = g2.select("*", (F.col("by_url") | F.col("sniffed")).alias("is_pdf"), (F.col("text") != "").alias("has_text"),
                   need_js.alias("need_js"))
    b_wins = (F.col("need_js") & F.lit(p.js_render != "never") & B.isNotNull() & (B["status"] == 200)
              & (B["full_len"] > F.col("s_len")))
    g4 = g3.select("*", F.coalesce(b_wins, F.lit(False)).alias("b_wins"))
    g5 = g4.select(
        "*",
        F.when(F.col("b_wins"), B["content"]).when(s_status == 200, S["content"]).otherwise(F.lit("")).alias("hc"),
        F.when(F.col("b_wins"), B["full_len"]).otherwise(F.col("s_len")).alias("hfull"))
    is_pdf, has_text, by_url, sniffed = F.col("is_pdf"), F.col("has_text"), F.col("by_url"), F.col("sniffed")
    bw, hc, text = F.col("b_wins"), F.col("hc"), F.col("text")
    got = hc != ""
    # text is success, whatever the capture's own status was
    status = (F.when(is_pdf & has_text, F.lit(200)).when(is_pdf, F.coalesce(s_status, F.lit(0))).when(bw, B["status"])
              .otherwise(F.coalesce(s_status, F.lit(0))))
    title = (F.when(by_url, F.when(has_text, F.col("ptitle")).otherwise(F.lit("")))
             .when(sniffed, F.col("ptitle"))
             .when(bw & (F.col("s_title") == ""), F.coalesce(B["meta_title"], F.lit("")))
             .otherwise(F.col("s_title")))
    content = F.when(is_pdf, truncate(text, p.max_len)).otherwise(hc)
    hlen = F.col("hfull") if p.max_len <= 0 else F.least(F.col("hfull"), F.lit(p.max_len).cast("bigint"))
    clen = (F.when(is_pdf, F.when(has_text, content_length(text, p.max_len)).otherwise(F.lit(0)))
            .when(got, hlen).otherwise(F.lit(0))).cast("bigint")
    method = (F.when(is_pdf, F.lit("pdf")).when(bw, F.lit("browser"))
              .when(F.col("has_s"), F.lit("static")).otherwise(F.lit("unknown")))
    error = (F.when(is_pdf & has_text, F.lit(None))
             .when(by_url, F.when(s_status == 200, F.lit(NO_PDF_TEXT))
                   .otherwise(F.coalesce(F.nullif(S["error"], F.lit("")), F.lit(PDF_FAILED))))
             .when(sniffed, F.lit(NO_PDF_TEXT))
             .when(got, F.lit(None))
             .otherwise(F.coalesce(F.nullif(S["error"], F.lit("")), F.lit(EMPTY_CONTENT))))
    queued = ~is_pdf & F.col("need_js") & F.lit(p.js_render != "never")
    return g5.select("url", status.cast("int").alias("status"), title.alias("title"), content.alias("content"),
                     clen.alias("content_length"), method.alias("method"), error.cast("string").alias("error"),
                     queued.alias("render_queued"), s_status.alias("static_status"), F.col("s_len").alias("static_len"))


def resolve(captures: DataFrame, pdf_pages: DataFrame | None = None, params: ResolveParams = ResolveParams()) -> DataFrame:
    """Row 22 (+20, 23, 31): per URL the winning tier, with every URL yielding a row.

    PDF text when routed to PDF; else the static capture; the browser
    capture replaces it only if the URL was queued for rendering, its status
    is 200 and its content is strictly longer.  Title: captured title, then
    the ``<title>`` metadata, then the rendered page's title.
    """
    return _decide(gather(captures, pdf_pages, params), params)


def render_queue(resolved: DataFrame) -> DataFrame:
    """Row 21: URLs that go to the browser tier (forced, or static content under the minimum)."""
    return resolved.filter("render_queued").select("url", "static_status", "static_len")


def capture_errors(resolved: DataFrame) -> DataFrame:
    """Row 23: URLs that resolved without content, with their status, method and error."""
    return resolved.filter(F.col("content") == "").select("url", "status", "method", "error")
