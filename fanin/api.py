"""The reference's four calls, in bulk: many queries / URLs per call, DataFrames in and out.

==================  ===========================================================
``search_urls``     recorded result pages of source A + items of source B +
                    per-query requests -> fused, ranked result rows
``search_cached``   the same behind the search memo: fresh sets are served, only the
                    rest is searched; also the memo's next snapshot
``scrape``          captures (+ PDF page texts) -> one resolved page per URL
``scrape_requests`` the same, one row per request with its own URL, format, length and
                    rendering mode
``web_research``    fused rows + captures + memo -> report rows, memo hits
                    served from the memo and only misses resolved
``deep_research``   raw requests -> validated, clamped, searched, reported
``reports``         the same, as one row per request: status, error, sources
                    used, count and the nested rows (also without results)
``remember``        resolved pages -> the next snapshot of the fetch memo
``engine_status``   memo -> entries, size, oldest / newest age
==================  ===========================================================
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.functions.text import pystrip
from fanin.operators import capture as CA
from fanin.operators import fuse as FU
from fanin.operators import intake as IN
from fanin.operators import memo as ME
from fanin.operators import normalise as NO
from fanin.operators import report as RE
from fanin.params import FETCH_TTL_S, MAX_MEMO_ENTRIES, SEARCH_TTL_S, URL_ERROR, FusionParams, PagingParams
from fanin.session import ensure_checkpoint_dir
from fanin.sources.tables import flatten_pages

PAGE_COLUMNS = ["url", "status", "content", "content_length", "method", "error"]


def require(df: DataFrame, what: str, *cols: str) -> None:
    """Fail early, with the input's name, when a needed column is missing (no Spark job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {missing}; it has {df.columns}")


def search_urls(pages_a: DataFrame, items_b: DataFrame, requests: DataFrame, as_of_us: int,
                outcomes: DataFrame | None = None, params: FusionParams = FusionParams(),
                paging: PagingParams = PagingParams()) -> DataFrame:
    """Rows 1, 7-16: ``requests(query_id, num_results, time_range)`` (already clamped).

    Source A pages are flattened in order; both sources' items are filtered by
    the query's time range first, so that every later bound counts rows in
    range only; then come the page limits (if ``paging`` sets any), the
    normalisation with its exact-URL dedupe, and the fusion of the sources that
    answered to each query's ``num_results``.
    """
    require(pages_a, "pages_a", "query_id", "source", "page_no", "items")
    require(items_b, "items_b", "query_id", "pos", "href", "url", "title", "body")
    require(requests, "requests", "query_id", "num_results", "time_range")
    if outcomes is not None:
        require(outcomes, "outcomes", "query_id", "source", "outcome")
    a_items = IN.time_range_filter(flatten_pages(pages_a), requests, as_of_us)
    if paging.max_pages is not None:
        a_items = IN.page_early_stop(a_items, requests, paging.per_page, paging.max_pages)
    b_items = IN.time_range_filter(items_b, requests, as_of_us)
    results = NO.union_sources(NO.normalise_a(a_items, requests, params.sources[0], params.max_results),
                               NO.normalise_b(b_items, requests, params.sources[1], params.max_results, paging.source_b_max))
    return FU.fuse(results, requests=requests, outcomes=outcomes, params=params)


def search_cached(pages_a: DataFrame, items_b: DataFrame, requests: DataFrame, memo: DataFrame, as_of_us: int, outcomes: DataFrame,
                  requested: tuple[str, ...], ttl_s: int = SEARCH_TTL_S, params: FusionParams = FusionParams(),
                  paging: PagingParams = PagingParams(), max_entries: int = MAX_MEMO_ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows 34-38 around the search call: ``(rows, queries, next memo)``.

    ``memo(key, ts_us, results, sources_used)`` holds whole result sets under the key of a search (its text -- ``query``
    if the requests have it, else ``query_id`` -- count, time range and sources).  A fresh set is served as it is, empty
    and partial ones too, with ``cached = true``; the recorded pages of the other queries alone are searched.
    ``queries`` has one row per request: cached, status, sources used and count.  Every searched set that did not error
    enters the next memo at ``as_of``.  The looked-up requests and the searched rows are written once, as each feeds
    several results."""
    require(memo, "memo", "key", "ts_us", "results", "sources_used")
    require(outcomes, "outcomes", "query_id", "source", "outcome")
    ensure_checkpoint_dir(memo.sparkSession)
    text = "query" if "query" in requests.columns else "query_id"
    keyed = requests.select("query_id", "num_results", "time_range", ME.search_key(text, "num_results", "time_range", params.sources).alias("key"))
    found = ME.split(keyed, memo, as_of_us, ttl_s, ("results", "sources_used")).checkpoint(eager=True)
    misses = found.filter(~F.col("cached")).select("query_id", "num_results", "time_range", "key")
    asked = lambda df: df.join(misses.select("query_id"), "query_id", "left_semi")
    fused = search_urls(asked(pages_a), asked(items_b), misses.drop("key"), as_of_us, asked(outcomes), params, paging).checkpoint(eager=True)
    fields = [f for f in ME.RESULT_FIELDS if f in fused.columns]
    served = found.filter("cached").select("query_id", F.explode("memo_results").alias("_r")).select("query_id", *[F.col(f"_r.{f}").alias(f) for f in fields], F.lit(True).alias("cached"))
    rows = fused.select("query_id", *fields, F.lit(False).alias("cached")).unionByName(served)
    status = FU.all_failed(fused, asked(outcomes))
    sets = ME.result_sets(fused, ME.admit_searches(status), FU.sources_used(outcomes, requested))
    new = sets.join(misses.select("query_id", "key"), "query_id").select("key", F.lit(as_of_us).cast("bigint").alias("ts_us"), F.col("results").cast(memo.schema["results"].dataType).alias("results"), "sources_used")
    counts = fused.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    done = found.join(status.select("query_id", "status"), "query_id", "left").join(counts, "query_id", "left").join(FU.sources_used(outcomes, requested).select("query_id", F.col("sources_used").alias("_used")), "query_id", "left")
    hit, n = F.col("cached"), F.when(F.col("cached"), F.size("memo_results")).otherwise(F.coalesce("_n", F.lit(0)))
    queries = done.select("query_id", "cached", F.when(hit, F.when(n > 0, "ok").otherwise("empty")).otherwise(F.coalesce("status", F.lit("empty"))).alias("status"),
                          F.when(hit, F.col("memo_sources_used")).otherwise(F.coalesce("_used", F.lit(""))).alias("sources_used"), n.cast("bigint").alias("num_results"))
    return rows, queries, ME.prune(ME.upsert(memo.select("key", "ts_us", "results", "sources_used"), new), max_entries)


def scrape(captures: DataFrame, pdf_pages: DataFrame | None = None,
           params: CA.ResolveParams = CA.ResolveParams()) -> DataFrame:
    """Rows 19-23: one resolved page per URL (status, title, content, content_length, method, error)."""
    require(captures, "captures", "url", "tier", "status")
    if pdf_pages is not None:
        require(pdf_pages, "pdf_pages", "url", "page_no", "text")
    return CA.resolve(captures, pdf_pages, params)


def scrape_requests(requests: DataFrame, captures: DataFrame, pdf_pages: DataFrame | None = None,
                    params: CA.ResolveParams = CA.ResolveParams()) -> DataFrame:
    """Rows 19-23 per request ``(request_id, url, format, max_content_length, js_render)``, values as text.

    The length is clamped as at intake; format is 'text' or else markdown;
    js_render 'always' forces the browser tier.  A blank URL is refused with a
    reason, a URL without a capture is an empty page of unknown method; every
    request has its row.  Each URL is resolved once per format and mode, at the
    largest length asked for it.
    """
    require(requests, "requests", "request_id", "url", "format", "max_content_length", "js_render")
    fmt = F.when(F.lower(pystrip(F.coalesce("format", F.lit("")))) == "text", F.lit("text")).otherwise(F.lit("markdown"))
    js = F.when(F.lower(pystrip(F.coalesce("js_render", F.lit("")))) == "always", F.lit("always")).otherwise(F.lit("auto"))
    asked = IN.clamp(requests.withColumn("num_results", F.lit(None).cast("string"))).select(
        "request_id", "url", fmt.alias("_fmt"), js.alias("_js"), F.col("max_content_length").alias("_ml"),
        (pystrip(F.coalesce("url", F.lit(""))) == "").alias("_blank"))
    parts = []
    for f in ("markdown", "text"):
        for j in ("auto", "always"):
            mine = asked.filter(~F.col("_blank") & (F.col("_fmt") == f) & (F.col("_js") == j))
            most = mine.groupBy("url").agg(F.max("_ml").alias("cut_len"))
            pdfs = pdf_pages.join(most.select("url"), "url", "left_semi") if pdf_pages is not None else None
            pages = CA.resolve(captures.join(most, "url"), pdfs, replace(params, fmt=f, js_render=j, max_len=0))
            parts.append(mine.join(pages.select(*PAGE_COLUMNS, "title"), "url", "left"))
    found = reduce(DataFrame.unionByName, parts)
    ml = F.col("_ml")
    found = found.select(
        "request_id", "url", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.col("content").substr(F.lit(1), ml), F.lit("")).alias("content"),
        F.coalesce(F.least("content_length", ml.cast("bigint")), F.lit(0)).alias("content_length"),
        F.coalesce("method", F.lit("unknown")).alias("method"),
        F.coalesce("error", F.when(F.col("status").isNull(), F.lit(CA.EMPTY_CONTENT))).alias("error"))
    refused = asked.filter("_blank").select(
        "request_id", "url", F.lit(0).alias("status"), F.lit("").alias("title"), F.lit("").alias("content"),
        F.lit(0).cast("bigint").alias("content_length"), F.lit("unknown").alias("method"), F.lit(URL_ERROR).alias("error"))
    return found.unionByName(refused)


def web_research(fused: DataFrame, captures: DataFrame, memo: DataFrame, as_of_us: int,
                 pdf_pages: DataFrame | None = None, ttl_s: int = FETCH_TTL_S,
                 params: CA.ResolveParams = CA.ResolveParams(), requests: DataFrame | None = None) -> DataFrame:
    """Rows 34-36, 22, 46: report rows for fused results.

    ``memo(key, ts_us, status, content)`` is keyed by ``fetch|url|fmt|max_len``.
    The fused lists are written once (they feed both the memo lookup and the
    report join); fresh memo entries are served with ``cached = true``; only
    the misses are resolved from the captures.

    With ``requests(query_id, max_content_length)`` each query gets its own
    length (as each call of the reference does): memo keys are per (URL,
    length), every missed URL is resolved once at the largest length asked for
    it (0 or less: whole) and cut per query afterwards.

    A hit returns all the memo holds: title, method, error and content length
    as well, where the memo has those columns.
    """
    require(fused, "fused", "query_id", "rank", "href", "title", "body", "source", "published_us")
    require(captures, "captures", "url", "tier", "status")
    require(memo, "memo", "key", "ts_us", "status", "content")
    ensure_checkpoint_dir(fused.sparkSession)
    if requests is None:
        fused = fused.checkpoint(eager=True).withColumn("_ml", F.lit(params.max_len))
    else:
        require(requests, "requests", "query_id", "max_content_length")
        lengths = requests.select("query_id", F.col("max_content_length").cast("int").alias("_len"))
        fused = (fused.join(lengths, "query_id", "left")
                 .withColumn("_ml", F.coalesce("_len", F.lit(params.max_len))).drop("_len")
                 .checkpoint(eager=True))
    wanted = fused.select(F.col("href").alias("url"), "_ml").distinct().withColumn(
        "key", ME.fetch_key(F.col("url"), F.lit(params.fmt), F.col("_ml")))
    payload = [c for c in ("status", "content", "content_length", "method", "error", "title") if c in memo.columns]
    split = ME.split(wanted, memo, as_of_us, ttl_s, tuple(payload))
    misses = split.filter(~F.col("cached")).select("url", "_ml")
    most = misses.groupBy("url").agg(F.when(F.min("_ml") <= 0, F.lit(0)).otherwise(F.max("_ml")).alias("cut_len"))
    caps = captures.join(most, "url")
    pdfs = pdf_pages.join(most.select("url"), "url", "left_semi") if pdf_pages is not None else None
    resolved = CA.resolve(caps, pdfs, replace(params, max_len=0)).select(*PAGE_COLUMNS)
    ml = F.col("_ml")       # one resolution per URL, cut to each requested length
    fetched = (resolved.join(misses, "url")
               .withColumn("content", F.when(ml <= 0, F.col("content")).otherwise(F.col("content").substr(F.lit(1), ml)))
               .withColumn("content_length", F.when(ml <= 0, F.col("content_length"))
                           .otherwise(F.least(F.col("content_length"), ml.cast("bigint")))))
    fetched = fetched.select(*PAGE_COLUMNS, "_ml", F.lit(False).alias("cached"))
    cut = F.when(F.col("_ml") <= 0, F.length("memo_content")).otherwise(F.least(F.length("memo_content"), F.col("_ml")))
    held = {c: F.col(f"memo_{c}") if c in payload else F.lit(None).cast("string") for c in ("method", "error")}
    length = F.coalesce(F.col("memo_content_length"), cut) if "content_length" in payload else cut
    hits = split.filter("cached").select(
        "url", F.col("memo_status").alias("status"), F.col("memo_content").alias("content"),
        length.cast("bigint").alias("content_length"), held["method"].alias("method"),
        held["error"].alias("error"), "_ml", F.lit(True).alias("cached"))
    pages = fetched.unionByName(hits)
    rows = RE.report_rows(fused, pages, on_length=True)
    return rows


def deep_research(requests_raw: DataFrame, pages_a: DataFrame, items_b: DataFrame, captures: DataFrame,
                  memo: DataFrame, as_of_us: int, outcomes: DataFrame | None = None,
                  pdf_pages: DataFrame | None = None, fusion: FusionParams = FusionParams(),
                  resolve_params: CA.ResolveParams = CA.ResolveParams(), paging: PagingParams = PagingParams(),
                  ttl_s: int = FETCH_TTL_S) -> DataFrame:
    """Rows 5-6 then the research call, from raw requests
    ``(query_id, query, num_results, max_content_length, time_range)`` as text.

    Requests are validated and clamped with the research defaults; rejected
    ones produce no report rows (``fanin.operators.intake.validate`` gives
    their reasons).  Each query's report uses its own ``num_results``,
    ``time_range`` and ``max_content_length``.
    """
    require(requests_raw, "requests_raw", "query_id", "query", "num_results", "max_content_length", "time_range")
    accepted = IN.clamp(IN.validate(requests_raw).filter("accepted"), "research")
    fused = search_urls(pages_a, items_b, accepted.select("query_id", "num_results", "time_range"), as_of_us,
                        outcomes=outcomes, params=fusion, paging=paging)
    return web_research(fused, captures, memo, as_of_us, pdf_pages=pdf_pages, ttl_s=ttl_s,
                        params=resolve_params, requests=accepted.select("query_id", "max_content_length"))


def reports(requests_raw: DataFrame, pages_a: DataFrame, items_b: DataFrame, captures: DataFrame, memo: DataFrame,
            as_of_us: int, outcomes: DataFrame, requested: tuple[str, ...], pdf_pages: DataFrame | None = None,
            fusion: FusionParams = FusionParams(), resolve_params: CA.ResolveParams = CA.ResolveParams(),
            paging: PagingParams = PagingParams(), ttl_s: int = FETCH_TTL_S, with_content: bool = False) -> DataFrame:
    """Rows 5-6, 17-18, 47 around the research call: one row for every raw request.

    ``query_id, query, status, error, sources_used, num_results, sources``:
    status is 'rejected' (with the reason), 'error' (no rows and a source
    failed), 'empty' or 'ok'; a request without rows has count 0 and an empty
    list.  ``requested`` are the source names in the order they were asked.
    """
    require(outcomes, "outcomes", "query_id", "source", "outcome")
    checked = IN.validate(requests_raw)
    accepted = IN.clamp(checked.filter("accepted"), "research")
    fused = search_urls(pages_a, items_b, accepted.select("query_id", "num_results", "time_range"), as_of_us,
                        outcomes=outcomes, params=fusion, paging=paging)
    rows = web_research(fused, captures, memo, as_of_us, pdf_pages=pdf_pages, ttl_s=ttl_s, params=resolve_params,
                        requests=accepted.select("query_id", "max_content_length"))
    nested = RE.report_nested(rows, FU.sources_used(outcomes, requested), with_content, queries=requests_raw)
    failed = (outcomes.filter(F.col("outcome") != "ok").groupBy("query_id")
              .agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("_failed")))
    asked = checked.select("query_id", "query", "reject_reason")      # a request without an id has its row too
    nested = nested.withColumnRenamed("query_id", "_nid")
    out = asked.join(nested, asked["query_id"].eqNullSafe(nested["_nid"])).drop("_nid").join(failed, "query_id", "left")
    status = (F.when(F.col("reject_reason").isNotNull(), F.lit("rejected")).when(F.col("num_results") > 0, F.lit("ok"))
              .when(F.col("_failed").isNotNull(), F.lit("error")).otherwise(F.lit("empty")))
    error = F.coalesce("reject_reason", F.when(status == "error", F.concat(F.lit("all search sources failed: "), F.col("_failed"))))
    used = F.when(F.col("reject_reason").isNull(), F.coalesce("sources_used", F.lit(""))).otherwise(F.lit(""))
    return out.select("query_id", "query", status.alias("status"), error.alias("error"), used.alias("sources_used"),
                      "num_results", "sources")


def remember(memo: DataFrame, resolved: DataFrame, as_of_us: int, params: CA.ResolveParams = CA.ResolveParams(),
             max_entries: int = MAX_MEMO_ENTRIES) -> DataFrame:
    """Rows 36-38: the memo's next snapshot after a scrape: successful pages admitted under their fetch key at
    ``as_of``, the newest ``max_entries`` kept.  Columns are the memo's own."""
    require(memo, "memo", "key", "ts_us", "status", "content")
    new = ME.admit_fetches(resolved).withColumn("key", ME.fetch_key(F.col("url"), F.lit(params.fmt), F.lit(params.max_len)))
    new = new.withColumn("ts_us", F.lit(as_of_us).cast("bigint"))
    cols = [F.col(c) if c in new.columns else F.lit(None).cast(memo.schema[c].dataType).alias(c) for c in memo.columns]
    return ME.prune(ME.upsert(memo, new.select(*cols)), max_entries)


def engine_status(memo: DataFrame, as_of_us: int, search_memo: DataFrame | None = None) -> DataFrame:
    """Row 40: the memo part of the status call; with the search memo, a row for each of the two (``memo``)."""
    require(memo, "memo", "ts_us", "content")
    fetched = ME.stats(memo, as_of_us)
    if search_memo is None:
        return fetched
    require(search_memo, "search_memo", "ts_us", "results")
    searched = ME.stats(search_memo, as_of_us, F.octet_length(F.to_json(F.struct("results"))))
    return fetched.select(F.lit("fetch").alias("memo"), "*").unionByName(searched.select(F.lit("search").alias("memo"), "*"))
