"""The search memo in the call, set-wise differences and exact boilerplate blocks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fanin import api, schemas
from fanin.operators import boilerplate as BO
from fanin.operators import report as RE
from fanin.params import FusionParams
from fanin.session import scratch_path
from fanin.sources.sinks import current_snapshot, publish_snapshot

MEMO = "key string, ts_us long, results array<struct<rank:bigint,title:string,href:string,body:string,source:string,published_us:bigint>>, sources_used string"


@pytest.fixture(scope="module")
def inputs(spark):
    item = lambda u: (u, "T " + u, "B", [], 1.0, None)
    pages_a = spark.createDataFrame([("q1", "a", 1, [item("https://e.com/1"), item("https://e.com/2")]), ("q2", "a", 1, [item("https://e.com/3")]),
                                     ("q3", "a", 1, [])], schemas.RESULT_PAGES)
    items_b = spark.createDataFrame([("q1", 0, "https://e.com/2", None, "t", "b", None), ("q4", 0, "https://e.com/9", None, "t", "b", None)],
                                    "query_id string, pos int, href string, url string, title string, body string, published_us long")
    outcomes = spark.createDataFrame([(q, s, "error" if q == "q4" or (q == "q2" and s == "b") else "ok") for q in ("q1", "q2", "q3", "q4") for s in ("a", "b")],
                                     "query_id string, source string, outcome string")
    requests = spark.createDataFrame([(f"q{k}", 10, "") for k in range(1, 5)], "query_id string, num_results int, time_range string")
    return pages_a, items_b, requests, outcomes


def call(inputs, memo, as_of, ttl=600):
    pages_a, items_b, requests, outcomes = inputs
    rows, queries, after = api.search_cached(pages_a, items_b, requests, memo, as_of * 1_000_000, outcomes, ("a", "b"), ttl_s=ttl, params=FusionParams(sources=("a", "b"), max_results=200))
    return (sorted((r.query_id, r.rank, r.href, r.cached) for r in rows.collect()),
            {r.query_id: (r.cached, r.status, r.sources_used, r.num_results) for r in queries.collect()}, after)


def test_second_run_serves_what_the_first_searched(spark, inputs):
    base = scratch_path(spark, "search-memo")
    empty = current_snapshot(spark, base, spark.createDataFrame([], MEMO).schema)
    rows, queries, after = call(inputs, empty, 1000)
    assert [r[3] for r in rows] == [False] * len(rows) and {r[0] for r in rows} == {"q1", "q2"}
    assert queries == {"q1": (False, "ok", "a,b", 2), "q2": (False, "ok", "a", 1), "q3": (False, "empty", "a,b", 0), "q4": (False, "error", "", 0)}
    first = publish_snapshot(after, base)
    memo = current_snapshot(spark, base, after.schema)
    assert memo.count() == 3                                  # empty and partial sets too, the errored one not
    again, queries, after = call(inputs, memo, 1600)
    assert [r[:3] for r in again] == [r[:3] for r in rows] and all(r[3] for r in again)
    assert queries == {"q1": (True, "ok", "a,b", 2), "q2": (True, "ok", "a", 1), "q3": (True, "empty", "a,b", 0), "q4": (False, "error", "", 0)}
    second = publish_snapshot(after, base)
    assert first != second and {r.ts_us for r in current_snapshot(spark, base, after.schema).collect()} == {1_000_000_000}
    late, queries, after = call(inputs, current_snapshot(spark, base, after.schema), 1601)
    assert not any(r[3] for r in late) and {r.ts_us for r in after.collect()} == {1_601_000_000}


def test_only_misses_are_searched(spark, inputs):
    _, _, after = call(inputs, spark.createDataFrame([], MEMO), 1000)
    pages_a, items_b, requests, outcomes = inputs
    other = pages_a.withColumn("items", F.array().cast(pages_a.schema["items"].dataType))     # what is recorded now is empty
    rows, _, _ = call((other, items_b.limit(0), requests, outcomes), after, 1001)
    assert {r[0] for r in rows} == {"q1", "q2"} and all(r[3] for r in rows)


def test_status_of_both_memos(spark, inputs):
    _, _, after = call(inputs, spark.createDataFrame([], MEMO), 1000)
    fetched = spark.createDataFrame([("k", 990_000_000, "abc")], "key string, ts_us long, content string")
    got = {r.memo: (r.entries, r.oldest_age_s, r.size_bytes > 0) for r in api.engine_status(fetched, 1_010_000_000, after).collect()}
    assert got == {"fetch": (1, 20.0, True), "search": (3, 10.0, True)}


def test_set_changes_count_copies_and_ignore_order(spark):
    rng = random.Random(3)
    runs = [[(q, k + 1, rng.choice("abcde")) for q in ("x", "y", "z", None) for k in range(rng.randint(0, 6))] for _ in range(2)]
    runs[0] += [("same", 1, "a"), ("same", 2, "b"), ("same", 3, None)]
    runs[1] += [("same", 1, None), ("same", 2, "b"), ("same", 3, "a")]
    a, b = (spark.createDataFrame(r, "query_id string, rank long, href string") for r in runs)
    ca, cb = (Counter((q, h) for q, _, h in r) for r in runs)
    want = {(q, h): (ca[q, h], cb[q, h]) for q, h in {*ca, *cb} if ca[q, h] != cb[q, h]}
    assert {(r.query_id, r.href): (r.n_a, r.n_b) for r in RE.result_set_changes(a, b).collect()} == want
    assert not any(q == "same" for q, _ in want)


def test_a_hash_collision_keeps_both_texts(spark):
    pages = spark.createDataFrame([(k, f"https://h.com/{k}", f"<p>own {k}</p><p>{'menu' if k < 3 else 'other'}</p><p>x{k % 2}</p>") for k in range(5)], "page_id int, url string, html string")
    same = lambda c: F.lit(1).cast("long")
    for h in (same, F.xxhash64):
        got = {r.page_id: r.main_text for r in BO.host_boilerplate(pages, 3, h).collect()}
        assert got == {0: "own 0", 1: "own 1\nx1", 2: "own 2", 3: "own 3\nother\nx1", 4: "own 4\nother"}


def test_a_request_without_an_id_has_its_report(spark, inputs):
    pages_a, items_b, _, outcomes = inputs
    raw = spark.createDataFrame([("q1", "q1", "5", None, ""), (None, " ", None, None, None)], "query_id string, query string, num_results string, max_content_length string, time_range string")
    caps = spark.createDataFrame([], "url string, tier string, status int, content_type string, html string, body binary, error string, captured_at long")
    memo = spark.createDataFrame([], "key string, ts_us long, status int, content string")
    out = api.reports(raw, pages_a, items_b, caps, memo, 0, outcomes, ("a", "b"), fusion=FusionParams(sources=("a", "b"), max_results=200)).collect()
    assert {(r.query_id, r.status, r.num_results) for r in out} == {("q1", "ok", 2), (None, "rejected", 0)}
