import random

from pyspark.sql import functions as F

from fanin.operators import fuse as FU
from fanin.operators import normalise as NO
from fanin.params import FusionParams
from pyref import check_fused, url_classes

P = FusionParams(sources=("a", "b"))
SCHEMA = "query_id string, source string, raw_rank int, href string"


def _results(spark, lists):
    rows = [("q", s, i, u) for s, items in lists.items() for i, u in enumerate(items)]
    return spark.createDataFrame(rows, SCHEMA)


def _fused(spark, lists, n, outcomes=None, params=P):
    out = FU.fuse(_results(spark, lists), n=n, outcomes=outcomes, params=params)
    return [(r.source, r.href) for r in out.orderBy("rank").collect()]


def test_exact_dedupe_in_source_a(spark):
    items = spark.createDataFrame([("q", 1, "https://a.com", "A", "aa"), ("q", 2, "https://a.com", "A dup", "aa2"),
                                   ("q", 3, "https://b.com", "B", "bb")],
                                  "query_id string, raw_pos long, url string, title string, content string")
    req = spark.createDataFrame([("q", 10)], "query_id string, num_results int")
    out = NO.normalise_a(items, req).orderBy("raw_rank").collect()
    assert [(r.href, r.title) for r in out] == [("https://a.com", "A"), ("https://b.com", "B")]
    assert out[0].source == "a" and out[0].engines == [] and out[0].score == 0.0


def test_interleave_and_dedupe(spark):
    got = _fused(spark, {"a": ["https://x.com", "https://y.com"], "b": ["https://x.com", "https://z.com"]}, 10)
    assert [h for _, h in got] == ["https://x.com", "https://y.com", "https://z.com"]


def test_respects_num_results(spark):
    lists = {"a": [f"https://s{i}.com" for i in range(5)], "b": [f"https://d{i}.com" for i in range(5)]}
    assert len(_fused(spark, lists, 3)) == 3


def test_one_source_down(spark):
    outcomes = spark.createDataFrame([("q", "a", "error"), ("q", "b", "ok")], "query_id string, source string, outcome string")
    got = _fused(spark, {"a": ["https://a.com"], "b": ["https://b.com"]}, 5, outcomes)
    assert got == [("b", "https://b.com")]
    used = FU.sources_used(outcomes, ("a", "b")).first()
    assert used.sources_used == "b" and used.sources_failed == "a"


def test_all_down_is_an_error_but_empty_is_not(spark):
    outcomes = spark.createDataFrame([("q", "a", "error"), ("q", "b", "skipped"), ("e", "a", "ok"), ("e", "b", "ok")],
                                     "query_id string, source string, outcome string")
    fused = FU.fuse(_results(spark, {"a": ["https://a.com"]}), n=5, outcomes=outcomes, params=P)
    st = {r.query_id: r for r in FU.all_failed(fused, outcomes).collect()}
    assert st["q"].status == "error" and st["q"].error.startswith("all search sources failed")
    assert st["e"].status == "empty" and st["e"].error is None


def test_sources_used_keeps_zero_row_and_unlisted_sources(spark):
    outcomes = spark.createDataFrame([("q", "unlisted", "ok"), ("q", "b", "ok"), ("q", "a", "ok")],
                                     "query_id string, source string, outcome string")
    assert FU.sources_used(outcomes, ("a", "b", "unlisted")).first().sources_used == "a,b,unlisted"


def test_random_lists_keep_best_occurrences(spark):
    rng = random.Random(3)
    pages = url_classes(4, 6)
    pool = sorted(pages)
    rows, cases = [], {}
    for q in range(40):
        lists = {s: [rng.choice(pool) for _ in range(rng.randint(0, 12))] for s in ("a", "b", "c")}
        n = rng.randint(1, 15)
        cases[f"q{q}"] = lists, n
        rows += [(f"q{q}", s, i, u, n) for s, items in lists.items() for i, u in enumerate(items)]
    df = spark.createDataFrame(rows, SCHEMA + ", n int")
    req = df.select("query_id", F.col("n").alias("num_results")).distinct()
    out = FU.fuse(df.drop("n"), requests=req, params=P).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.source, r.href))
    for q, (lists, n) in cases.items():
        check_fused(got.get(q, []), lists, ["a", "b"], n, pages)


def test_topk_plan_has_partial_window_group_limit(spark):
    df = _results(spark, {"a": ["https://x.com"], "b": ["https://y.com"]})
    plan = FU.fuse(df, n=20, params=P)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
