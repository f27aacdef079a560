from fanin.operators import report as RE

FUSED = "query_id string, rank long, href string, title string, body string, source string, published_us long"
PAGES = "url string, status int, method string, cached boolean, content_length long, content string, error string"


def test_report_structure_and_missing_page(spark):
    fused = spark.createDataFrame([("q", 1, "https://a.com", "A", "snippet a", "a", None),
                                   ("q", 2, "https://b.com", "B", "snippet b", "b", None),
                                   ("q", 3, "https://c.com", "C", "", "b", None)], FUSED)
    pages = spark.createDataFrame([("https://a.com", 200, "static", False, 100, "content a", None),
                                   ("https://b.com", 0, "none", False, 0, "", "empty content")], PAGES)
    rows = RE.report_rows(fused, pages)
    got = {r.url: r for r in rows.collect()}
    assert got["https://a.com"].status == 200 and got["https://b.com"].error == "empty content"
    assert (got["https://c.com"].status, got["https://c.com"].fetch_method, got["https://c.com"].cached,
            got["https://c.com"].content) == (0, None, False, "")
    nested = RE.report_nested(rows).first()
    assert nested.num_results == 3 and [s.url for s in nested.sources] == ["https://a.com", "https://b.com", "https://c.com"]
    assert "content" not in nested.sources[0].asDict()
    assert {r.error: r.n for r in RE.error_breakdown(rows).collect()} == {"empty content": 1, None: 1}


def test_scaling_and_diff(spark):
    small = spark.createDataFrame([("q", 1, "x")], "query_id string, rank long, href string")
    big = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query_id string, rank long, href string")
    assert RE.scaling_check(small, big).first().scaled
    diff = RE.result_set_diff(small, big).collect()
    assert [(r.rank, r.href_a, r.href_b) for r in diff] == [(2, None, "y")]


def test_scorecard_per_run(spark):
    rows = spark.createDataFrame([("r1", 200, "x"), ("r1", 0, ""), ("r2", 200, "y")], "run string, status int, content string")
    status = spark.createDataFrame([("r1", "ok"), ("r1", "error"), ("r2", "ok")], "run string, status string")
    got = {r.run: (r.queries_ok, r.queries_total, r.pages_ok, r.pages_total, r.success_pct)
           for r in RE.scrape_scorecard(rows, status, run="run").collect()}
    assert got == {"r1": (1, 2, 1, 2, 50.0), "r2": (1, 1, 1, 1, 100.0)}


def test_coverage_exact_and_sketch_agree_on_small_data(spark):
    fused = spark.createDataFrame([(f"q{i % 30}", f"https://www.h{i % 150}.com/p{i}") for i in range(900)],
                                  "query_id string, href string")
    a = RE.coverage(fused).first()
    b = RE.coverage(fused, exact=False).first()
    assert (a.queries_total, a.queries_ok, a.results_total) == (b.queries_total, b.queries_ok, b.results_total) == (30, 30, 900)
    assert a.unique_domains == 150 and abs(b.unique_domains - 150) <= 5
