from fanin.operators import capture as CA

CAP = "url string, tier string, status int, content_type string, html string, error string"
GOOD = "<html><head><title>T</title></head><body><article><h1>H</h1><p>" + "word " * 500 + "</p></article></body></html>"


def _resolve(spark, caps, pdf=None, **kw):
    c = spark.createDataFrame(caps, CAP)
    p = spark.createDataFrame(pdf, "url string, page_no int, text string") if pdf is not None else None
    return {r.url: r for r in CA.resolve(c, p, CA.ResolveParams(**kw)).collect()}


def test_pdf_by_url(spark):
    r = _resolve(spark, [("https://example.com/doc.pdf", "static", 200, "application/pdf", "", None)],
                 [("https://example.com/doc.pdf", 1, "PDF TEXT CONTENT")])["https://example.com/doc.pdf"]
    assert (r.method, r.content, r.status, r.error, r.title) == ("pdf", "PDF TEXT CONTENT", 200, None, "doc")


def test_pdf_by_url_error(spark):
    r = _resolve(spark, [("https://example.com/x.pdf", "static", 500, None, "", "boom")], [])["https://example.com/x.pdf"]
    assert (r.status, r.error, r.method, r.title) == (500, "boom", "pdf", "")


def test_sniffed_pdf_never_escalates(spark):
    caps = [("https://e.com/paper", "static", 200, "Application/PDF", "", None),
            ("https://e.com/paper", "browser", 200, "text/html", GOOD, None),
            ("https://e.com/raw", "static", 200, None, "%PDF-1.7 ...", None)]
    got = _resolve(spark, caps, [("https://e.com/paper", 1, "  "), ("https://e.com/paper", 2, "p2")])
    assert got["https://e.com/paper"].method == "pdf" and got["https://e.com/paper"].content == "p2"
    assert got["https://e.com/raw"].error == CA.NO_PDF_TEXT and got["https://e.com/raw"].title == "raw"


def test_static_success_no_escalation(spark):
    caps = [("https://e.com/p", "static", 200, "text/html", GOOD, None),
            ("https://e.com/p", "browser", 200, "text/html", GOOD + GOOD, None)]
    r = _resolve(spark, caps)["https://e.com/p"]
    assert r.method == "static" and "word" in r.content and r.title == "T" and not r.render_queued


def test_empty_static_escalates_to_browser(spark):
    caps = [("https://spa.e.com", "static", 200, "text/html", "<html></html>", None),
            ("https://spa.e.com", "browser", 200, "text/html", "<title>JS T</title><p>" + "RENDERED CONTENT " * 50 + "</p>", None)]
    r = _resolve(spark, caps)["https://spa.e.com"]
    assert r.method == "browser" and "RENDERED CONTENT" in r.content and r.title == "JS T"
    assert _resolve(spark, caps, js_render="never")["https://spa.e.com"].method == "static"


def test_browser_must_be_strictly_longer_and_queue_boundary(spark):
    def page(n):
        return "<p>" + "x" * n + "</p>"
    caps = [("u199", "static", 200, "text/html", page(199), None), ("u199", "browser", 200, "text/html", page(199), None),
            ("u200", "static", 200, "text/html", page(200), None), ("u200", "browser", 200, "text/html", page(300), None),
            ("u150", "static", 200, "text/html", page(150), None), ("u150", "browser", 200, "text/html", page(151), None)]
    got = _resolve(spark, caps)
    assert got["u199"].render_queued and got["u199"].method == "static"       # equal length does not win
    assert not got["u200"].render_queued and got["u200"].method == "static"   # 200 is enough
    assert got["u150"].method == "browser"


def test_failure_row_and_no_capture(spark):
    caps = [("https://e.com/x", "static", 0, None, "", "network unreachable"),
            ("https://e.com/x", "browser", 0, None, "", "browser broken")]
    got = _resolve(spark, caps, [("https://e.com/only-pdf-text", 1, "t")])
    r = got["https://e.com/x"]
    assert (r.status, r.error, r.content_length) == (0, "network unreachable", 0)
    assert got["https://e.com/only-pdf-text"].method == "unknown" and got["https://e.com/only-pdf-text"].status == 0


def test_max_len_truncates(spark):
    r = _resolve(spark, [("u", "static", 200, "text/html", GOOD, None)], max_len=100)["u"]
    assert len(r.content) == 100 and r.content_length == 100
