"""Cases off the fixtures: bounds that must not drop rows, preferences, identities and empty results."""

from pyspark.sql import functions as F

from fanin import api, schemas
from fanin.functions import html as H
from fanin.operators import capture as CA
from fanin.operators import fuse as FU
from fanin.operators import health as HE
from fanin.operators import memo as ME
from fanin.operators import report as RE
from fanin.operators import retrieve as RT
from fanin.params import FusionParams, PagingParams
from pyref import ttl_hits

CAP = "url string, tier string, status int, content_type string, html string, error string, captured_at long"
AS_OF = 1_700_000_000_000_000
DAY = 86_400_000_000


def page(text):
    return f"<html><body><p>{text}</p></body></html>"


def test_frequent_terms_still_match(spark):
    docs = spark.createDataFrame([(1, "spark one"), (2, "spark two"), (3, "spark spark"), (4, "other")], "id long, t string")
    q = RT.query_terms(spark.createDataFrame([("q", "spark")], "qid string, t string"), "qid", "t")
    got = RT.retrieve_ranked(q, RT.postings(docs, "id", F.col("t")), 10, "a").orderBy("raw_rank").collect()
    assert [(r.doc_id, r.hits) for r in got] == [(3, 2), (1, 1), (2, 1)]


def test_results_in_range_are_found_behind_old_ones(spark):
    item = lambda u, at: (u, u, u, [], 1.0, at)
    pages_a = spark.createDataFrame([("q", "a", 1, [item("https://e.com/old", AS_OF - 9 * DAY), item("https://e.com/new", AS_OF - 1)])],
                                    schemas.RESULT_PAGES)
    items_b = spark.createDataFrame([], schemas.RAW_B)
    req = spark.createDataFrame([("q", 1, "d")], "query_id string, num_results int, time_range string")
    for paging in (PagingParams(), PagingParams(per_page=1, max_pages=10)):
        rows = api.search_urls(pages_a, items_b, req, AS_OF, paging=paging).collect()
        assert [r.href for r in rows] == ["https://e.com/new"]


def test_all_recorded_pages_take_part_by_default(spark):
    item = lambda u: (u, u, u, [], 1.0, None)
    pages = [("q", "a", p, [item(f"https://e.com/{p}")]) for p in (1, 4, 15)]
    req = spark.createDataFrame([("q", 300, "")], "query_id string, num_results int, time_range string")
    b = spark.createDataFrame([("q", i, f"https://b.com/{i}", None, "", "", None) for i in range(250)], schemas.RAW_B)
    out = api.search_urls(spark.createDataFrame(pages, schemas.RESULT_PAGES), b, req, AS_OF, params=FusionParams(max_results=300))
    assert out.count() == 253


def test_fusion_gives_as_many_as_asked(spark):
    df = spark.createDataFrame([("q", "a", i, f"https://e.com/{i}") for i in range(320)],
                               "query_id string, source string, raw_rank int, href string")
    assert FU.fuse(df, n=300, params=FusionParams(max_results=300)).count() == 300
    assert FU.fuse(df, n=300).count() == 300
    req = spark.createDataFrame([("q", 310)], "query_id string, num_results int")
    assert FU.fuse(df, requests=req, params=FusionParams(max_results=400)).count() == 310


FUSED = "query_id string, rank long, href string, title string, body string, source string, published_us long"
MEMO = "key string, ts_us long, status int, title string, content string, content_length long, method string, error string"


def test_length_zero_keeps_all(spark):
    fused = spark.createDataFrame([("q", 1, "u", "T", "", "a", None), ("p", 1, "u", "T", "", "a", None)], FUSED)
    caps = spark.createDataFrame([("u", "static", 200, "text/html", page("x" * 600_000), None, None)], CAP)
    memo = spark.createDataFrame([], MEMO)
    req = spark.createDataFrame([("q", 0), ("p", 700)], "query_id string, max_content_length int")
    got = {r.query_id: (len(r.content), r.content_length) for r in api.web_research(fused, caps, memo, AS_OF, requests=req).collect()}
    assert got == {"q": (600_000, 600_000), "p": (700, 700)}


def test_a_memo_hit_returns_all_it_holds(spark):
    fused = spark.createDataFrame([("q", 1, "u", "T", "", "a", None)], FUSED)
    key = spark.range(1).select(ME.fetch_key(F.lit("u"), F.lit("markdown"), F.lit(20000)).alias("k")).first().k
    memo = spark.createDataFrame([(key, AS_OF, 200, "t", "text", 900, "browser", "late")], MEMO)
    r = api.web_research(fused, spark.createDataFrame([], CAP), memo, AS_OF).first()
    assert (r.cached, r.fetch_method, r.error, r.content_length, r.content) == (True, "browser", "late", 900, "text")


def resolve(spark, caps, pdf=None):
    p = None if pdf is None else spark.createDataFrame(pdf, "url string, page_no int, text string")
    return {r.url: r for r in CA.resolve(spark.createDataFrame(caps, CAP), p).collect()}


def test_a_good_capture_goes_before_a_later_failure(spark):
    got = resolve(spark, [("u", "static", 200, "text/html", page("good " * 80), None, 5), ("u", "static", 404, "text/html", page("gone"), "x", 9),
                          ("v", "static", 200, "text/html", page("old " * 80), None, 5), ("v", "static", 200, "text/html", page("new " * 80), None, 6)])
    assert got["u"].status == 200 and "good" in got["u"].content and "new" in got["v"].content


def test_pdf_text_is_success(spark):
    got = resolve(spark, [("https://e.com/b.pdf", "static", 403, None, "", "no", None)],
                  [("https://e.com/a.pdf", 1, "text a"), ("https://e.com/b.pdf", 1, "text b")])
    assert [(got[f"https://e.com/{x}.pdf"].status, got[f"https://e.com/{x}.pdf"].error) for x in "ab"] == [(200, None)] * 2


def test_metadata_values_end_at_their_own_quote(spark):
    h = """<meta name="description" content="It's a long text"><meta content='say "hi"' name='author'><meta property="og:site_name" content="">"""
    m = spark.range(1).select(H.page_metadata(F.lit(h)).alias("m")).first().m
    assert (m.description, m.author, m.sitename) == ("It's a long text", 'say "hi"', None)


def test_table_cells_stay_apart(spark):
    r = spark.range(1).select(H.extract_text(F.lit("<table><tr><th>c1</th><td>c2</td></tr></table>")).alias("t")).first()
    assert r.t == "c1 c2"


def test_a_query_without_results_has_its_report(spark):
    rows = spark.createDataFrame([], schemas.REPORT_ROW)
    used = spark.createDataFrame([("q", "a", "")], "query_id string, sources_used string, sources_failed string")
    out = RE.report_nested(rows, used, queries=spark.createDataFrame([("q",), ("p",)], "query_id string")).collect()
    assert {(r.query_id, r.num_results, len(r.sources), r.sources_used) for r in out} == {("q", 0, 0, "a"), ("p", 0, 0, None)}


def test_ids_are_unique_per_key_only_and_keys_may_be_null(spark):
    logs = {"k": [0, 3, 7, 8, 30, 31, 45], "l": [1, 2, 9, 20], None: [5, 6, 40]}
    rows = [(k, i, t * 1_000_000) for k, ts in logs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "req_key string, event_id long, ts_us long")
    for target in (None, 2):
        out = ME.ttl_replay(df, 6, target_rows=target).collect()
        assert len(out) == len(rows)
        got = {(r.req_key, r.event_id): r.hit for r in out}
        for k, ts in logs.items():
            assert [got[k, i] for i in range(len(ts))] == ttl_hits(ts, 6)


def test_attempts_without_a_key_are_counted(spark):
    df = spark.createDataFrame([(None, 1, 10, False, "e"), (None, 2, 11, False, "f"), ("s", 1, 10, False, "e"), ("s", 2, 12, True, None)],
                               "source string, event_id long, ts_us long, ok boolean, error string")
    got = {(r.source, r.event_id): r.streak for r in HE.failure_streaks(df).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("s", 1): 1, ("s", 2): 0}
    front = {r.source: (r.state, r.failures, r.last_error) for r in HE.retry_frontier(df, key="source").collect()}
    assert front == {None: ("retry", 2, "f"), "s": ("done", 0, None)}


def test_no_job_runs_while_a_frame_is_built(spark):
    caps = spark.createDataFrame([("u", "static", 200, "text/html", page("x"), None, None)] * 3, CAP).repartition(2, "url")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    CA.resolve(caps)
    jobs = tracker.getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_reports_have_a_row_for_every_request(spark):
    item = lambda u: (u, u, u, [], 1.0, None)
    pages_a = spark.createDataFrame([("ok", "a", 1, [item("https://e.com/a")]), ("bad", "a", 1, [item("https://e.com/a")])], schemas.RESULT_PAGES)
    raw = spark.createDataFrame([("ok", " x ", "5", None, ""), ("bad", "  ", "5", None, ""), ("range", "x", "5", None, "q"),
                                 ("failed", "x", "5", None, None), ("none", "x", "5", None, "")],
                                "query_id string, query string, num_results string, max_content_length string, time_range string")
    outcomes = spark.createDataFrame([("ok", "a", "ok"), ("failed", "a", "error"), ("failed", "b", "skipped"), ("none", "a", "ok"), ("none", "b", "ok")],
                                     "query_id string, source string, outcome string")
    caps = spark.createDataFrame([("https://e.com/a", "static", 200, "text/html", page("data " * 100), None, None)], CAP)
    out = {r.query_id: r for r in api.reports(raw, pages_a, spark.createDataFrame([], schemas.RAW_B), caps, spark.createDataFrame([], MEMO), AS_OF,
                                              outcomes, ("a", "b"), with_content=True).collect()}
    assert {k: (r.status, r.num_results, len(r.sources), r.sources_used) for k, r in out.items()} == {
        "ok": ("ok", 1, 1, "a"), "bad": ("rejected", 0, 0, ""), "range": ("rejected", 0, 0, ""), "failed": ("error", 0, 0, ""),
        "none": ("empty", 0, 0, "a,b")}
    assert out["failed"].error == "all search sources failed: a, b" and out["bad"].error and out["none"].error is None
    assert "data" in out["ok"].sources[0].content


def test_remembered_pages_are_served_next_time(spark):
    caps = spark.createDataFrame([("u", "static", 200, "text/html", page("data " * 100), None, None),
                                  ("v", "static", 500, "text/html", "", "boom", None)], CAP)
    memo = api.remember(spark.createDataFrame([("old", 1, 200, "t", "c", 1, "static", None)], MEMO), api.scrape(caps), AS_OF)
    assert memo.count() == 2 and memo.columns == spark.createDataFrame([], MEMO).columns
    fused = spark.createDataFrame([("q", 1, "u", "T", "", "a", None), ("q", 2, "v", "T", "", "a", None)], FUSED)
    rows = {r.url: r for r in api.web_research(fused, caps.limit(0), memo, AS_OF + 1).collect()}
    assert (rows["u"].cached, rows["u"].fetch_method, rows["v"].cached) == (True, "static", False)
    assert api.remember(memo, api.scrape(caps.limit(0)), AS_OF, max_entries=1).count() == 1


def test_entities_are_decoded_once(spark):
    h = "<p>a&#8217;b&#x27;c&mdash;d&eacute;e&hellip; &amp;#39; &amp;eacute; &#0; &#xD800; &#128512; &#; &# &#12 &#x1F600;&#00065;</p>"
    r = spark.range(1).select(H.extract_text(F.lit(h)).alias("t")).first()
    assert r.t == "a’b'c—dée… &#39; &eacute; &#0; &#xD800; 😀 &#; &# &#12 😀A"


def test_scrape_requests_have_their_own_format_length_and_mode(spark):
    head = "<html><body><h2>Head</h2><p>" + "word " * 300 + "</p></body></html>"
    caps = spark.createDataFrame([("u", "static", 200, "text/html", head, None, None),
                                  ("u", "browser", 200, "text/html", head.replace("</p>", "more</p>"), None, None)], CAP)
    asks = spark.createDataFrame([(1, "u", None, "600", None), (2, "u", "TEXT ", "700", ""), (3, "u", "markdown", None, " Always"),
                                  (4, " ", None, None, None), (5, "v", None, None, None), (6, None, "text", "x", "always")],
                                 "request_id long, url string, format string, max_content_length string, js_render string")
    got = {r.request_id: r for r in api.scrape_requests(asks, caps).collect()}
    assert len(got) == 6
    assert got[1].content.startswith("## Head") and len(got[1].content) == got[1].content_length == 600 and got[1].method == "static"
    assert got[2].content.startswith("Head") and len(got[2].content) == 700
    assert got[3].method == "browser" and got[3].content.endswith("more") and got[3].content_length == len(got[3].content)
    assert got[4].error == got[6].error == "url must be a non-empty string"
    assert (got[5].status, got[5].method, got[5].content, got[5].error) == (0, "unknown", "", CA.EMPTY_CONTENT)


def test_a_burst_is_cut_into_equal_ranges(spark):
    from fanin.operators import ordered as OR
    year = 365 * 86_400 * 1_000_000
    df = spark.createDataFrame([("k", 0, 0)] + [("k", year + i // 500, i) for i in range(1, 4000)], "_key string, ts long, rid long").repartition(6)
    n = OR.equal_rows(df, 200)
    sizes = [r["count"] for r in OR.attach_chunk(df, "_key", F.col("ts"), n, ("ts", "rid")).groupBy("_c").count().collect()]
    assert n.parts == 20 and sum(sizes) == 4000 and max(sizes) <= 500
    log = df.select(F.col("_key").alias("source"), F.col("rid").alias("event_id"), F.col("ts").alias("ts_us"), (F.col("rid") % 97 == 0).alias("ok"))
    got = {r.event_id: r.streak for r in HE.failure_streaks(log, target_rows=200).collect()}
    assert got == {i: i % 97 for i in range(4000)}


def test_calls_without_a_host_have_their_schedule(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 2, 10), ("h", 3, 5)], "host string, event_id long, arrival_us long")
    got = {r.event_id: r.start_us for r in HE.polite_schedule(df, interval_us=100).collect()}
    assert got == {1: 0, 2: 100, 3: 5}
