from pyspark.sql import functions as F

from fanin import api
from fanin.operators import capture as CA
from fanin.operators import memo as ME

FUSED = "query_id string, rank long, href string, title string, body string, source string, published_us long"
CAP = "url string, tier string, status int, content_type string, html string, error string"
MEMO = "key string, ts_us long, status int, content string"
GOOD = "<html><body><p>" + "data " * 400 + "</p></body></html>"
AS_OF = 1_700_000_000_000_000


def test_second_research_call_is_served_from_the_memo(spark):
    fused = spark.createDataFrame([("q", 1, "https://example.com/page", "T", "s", "a", None)], FUSED)
    caps = spark.createDataFrame([("https://example.com/page", "static", 200, "text/html", GOOD, None)], CAP)
    memo = spark.createDataFrame([], MEMO)
    p = CA.ResolveParams(max_len=8000)
    first = api.web_research(fused, caps, memo, AS_OF, params=p).first()
    assert first.cached is False and first.status == 200 and "data" in first.content

    pages = api.scrape(caps, None, p)
    new = (ME.admit_fetches(pages)
           .select(ME.fetch_key(F.col("url"), F.lit(p.fmt), F.lit(p.max_len)).alias("key"),
                   F.lit(AS_OF).cast("bigint").alias("ts_us"), "status", "content"))
    memo2 = ME.upsert(memo, new)
    second = api.web_research(fused, caps.limit(0), memo2, AS_OF + 10**6, params=p).first()
    assert second.cached is True and second.content == first.content and second.status == 200
    assert api.engine_status(memo2, AS_OF).first().entries == 1


def test_missing_columns_are_named(spark):
    import pytest
    bad = spark.createDataFrame([("u",)], "url string")
    with pytest.raises(ValueError, match="captures lacks column"):
        api.scrape(bad)


def test_per_query_lengths_match_one_call_per_length(spark):
    fused = spark.createDataFrame([("q1", 1, "https://e.com/a", "A", "", "a", None), ("q2", 1, "https://e.com/a", "A", "", "a", None),
                                   ("q2", 2, "https://e.com/b", "B", "", "b", None), ("q3", 1, "https://e.com/b", "B", "", "b", None)],
                                  FUSED)
    caps = spark.createDataFrame([("https://e.com/a", "static", 200, "text/html", GOOD, None),
                                  ("https://e.com/b", "static", 200, "text/html", "<p>" + "zz " * 900 + "</p>", None)], CAP)
    memo = spark.createDataFrame([(ME_KEY_B700, AS_OF, 200, "from memo")], MEMO)
    req = spark.createDataFrame([("q1", 500), ("q2", 700)], "query_id string, max_content_length int")
    got = {(r.query_id, r.url): (r.content_length, r.content, r.cached)
           for r in api.web_research(fused, caps, memo, AS_OF, requests=req, params=CA.ResolveParams(max_len=900)).collect()}
    for q, n in (("q1", 500), ("q2", 700), ("q3", 900)):     # q3 has no request row: the call's length
        one = api.web_research(fused.filter(F.col("query_id") == q), caps, memo, AS_OF, params=CA.ResolveParams(max_len=n))
        for r in one.collect():
            assert got[(q, r.url)] == (r.content_length, r.content, r.cached), (q, r.url)
    assert got[("q2", "https://e.com/b")][2] is True and got[("q3", "https://e.com/b")][2] is False


ME_KEY_B700 = __import__("hashlib").sha256(b"fetch|https://e.com/b|markdown|700").hexdigest()


def test_deep_research_from_raw_requests(spark):
    from fanin import schemas
    item = lambda u, t: (u, t, t, [], 1.0, None)
    pages_a = spark.createDataFrame([("q1", "a", 1, [item("https://e.com/a", "A"), item("https://e.com/b", "B")]),
                                     ("bad", "a", 1, [item("https://e.com/a", "A")])], schemas.RESULT_PAGES)
    items_b = spark.createDataFrame([("q1", 0, "https://E.com/a/", None, "A2", "", None)], schemas.RAW_B)
    caps = spark.createDataFrame([("https://e.com/a", "static", 200, "text/html", GOOD, None)], CAP)
    raw = spark.createDataFrame([("q1", " hello ", "1", "600", " "), ("bad", "   ", "5", None, "")],
                                "query_id string, query string, num_results string, max_content_length string, time_range string")
    rows = api.deep_research(raw, pages_a, items_b, caps, spark.createDataFrame([], MEMO), AS_OF).collect()
    assert [(r.query_id, r.rank, r.url, r.content_length) for r in rows] == [("q1", 1, "https://e.com/a", 600)]
