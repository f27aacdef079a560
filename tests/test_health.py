import random

import pytest

from fanin.operators import health as HE
from fanin.operators import memo as ME
from fanin.params import BreakerParams
from pyspark.sql import functions as F

from pyref import breaker as ref_breaker
from pyref import polite as ref_polite
from pyref import ttl_hits as ref_ttl

ATT = "event_id long, source string, ts_us long, ok boolean"


def _random_log(rng, keys, n, span_us, p_ok=0.6, hot=None):
    rows = []
    for i in range(n):
        k = hot if hot and rng.random() < 0.4 else rng.choice(keys)
        rows.append((i, k, rng.randint(0, span_us) // 1000 * 1000, rng.random() < p_ok))
    return rows


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_breaker_reference_case(spark):
    # threshold 2: fail, fail -> opens; inside the cool-down skipped; after it allowed; success resets
    rows = [(1, "s", 0, False), (2, "s", 10, False), (3, "s", 20, True), (4, "s", 200, True), (5, "s", 210, False)]
    df = spark.createDataFrame(rows, ATT)
    got = {r.event_id: (r.allowed, r.opened) for r in HE.breaker_replay(df, params=BreakerParams(2, 100e-6)).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (True, False), 5: (True, False)}


CHUNKINGS = [dict(chunk_us=7_000), dict(chunk_us=10**9), dict(target_rows=9), dict()]


@pytest.mark.parametrize("chunking", CHUNKINGS)
def test_breaker_random_matches_fold(spark, chunking):
    rng = random.Random(11)
    rows = _random_log(rng, ["a", "b", "c"], 600, 2_000_000, p_ok=0.45, hot="a")
    df = spark.createDataFrame(rows, ATT)
    p = BreakerParams(threshold=2, cooldown_s=0.05)
    got = {r.event_id: r.allowed for r in HE.breaker_replay(df, params=p, **chunking).collect()}
    for k, seq in _by_key(rows).items():
        exp = ref_breaker([(r[2], r[3]) for r in seq], 2, 50_000)
        assert [got[r[0]] for r in seq] == exp, k


@pytest.mark.parametrize("chunking", [dict(chunk_us=5_000_000), dict(target_rows=7), dict()])
def test_ttl_replay_random_matches_fold(spark, chunking):
    rng = random.Random(5)
    rows = _random_log(rng, ["x", "y"], 500, 1_000_000, hot="x")
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "event_id long, req_key string, ts_us long")
    got = {r.event_id: r.hit for r in ME.ttl_replay(df.withColumn("ts_us", df.ts_us * 1000), ttl_s=30,
                                                      **chunking).collect()}
    for k, seq in _by_key(rows).items():
        exp = ref_ttl([r[2] * 1000 for r in seq], 30 * 10**6)
        assert [got[r[0]] for r in seq] == exp, k


def test_breaker_without_cooldown_and_threshold_one(spark):
    rng = random.Random(2)
    rows = _random_log(rng, ["a", "b"], 200, 50_000, p_ok=0.5)
    rows += [(1000 + i, "a", 777_000, False) for i in range(3)]      # ties in time
    df = spark.createDataFrame(rows, ATT)
    for th, cd in ((1, 0.0), (2, 0.0), (1, 0.002)):
        got = {r.event_id: r.allowed for r in HE.breaker_replay(df, params=BreakerParams(th, cd)).collect()}
        for k, seq in _by_key(rows).items():
            assert [got[r[0]] for r in seq] == ref_breaker([(r[2], r[3]) for r in seq], th, int(cd * 1_000_000)), (th, cd, k)


def test_ttl_negative_means_always_miss(spark):
    df = spark.createDataFrame([(1, "k", 0), (2, "k", 0)], "event_id long, req_key string, ts_us long")
    assert not any(r.hit for r in ME.ttl_replay(df, ttl_s=-1).collect())


@pytest.mark.parametrize("chunking", [dict(chunk_us=3_000), dict(target_rows=11), dict()])
def test_polite_schedule_and_streaks_random(spark, chunking):
    rng = random.Random(9)
    rows = _random_log(rng, ["h1", "h2"], 400, 300_000, hot="h1")
    calls = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "event_id long, host string, arrival_us long")
    got = {r.event_id: r.start_us for r in HE.polite_schedule(calls, interval_us=1_000, **chunking).collect()}
    att = spark.createDataFrame(rows, ATT)
    streak = {r.event_id: r.streak for r in HE.failure_streaks(att, **chunking).collect()}
    for k, seq in _by_key(rows).items():
        assert [got[r[0]] for r in seq] == ref_polite([r[2] for r in seq], 1_000), k
        run, exp = 0, []
        for r in seq:
            run = 0 if r[3] else run + 1
            exp.append(run)
        assert [streak[r[0]] for r in seq] == exp, k


def test_retry_frontier(spark):
    rows = [(1, "u1", 0, False, "http 500"), (2, "u1", 10, False, "http 502"),
            (3, "u2", 0, False, "e"), (4, "u2", 1, False, "e"), (5, "u2", 2, False, "timeout"),
            (6, "u3", 0, False, "e"), (7, "u3", 5, True, None)]
    df = spark.createDataFrame(rows, "event_id long, url string, ts_us long, ok boolean, error string")
    got = {r.url: r for r in HE.retry_frontier(df).collect()}
    assert (got["u1"].state, got["u1"].failures, got["u1"].next_due_us, got["u1"].last_error) == ("retry", 2, 3_000_010, "http 502")
    assert (got["u2"].state, got["u2"].last_error, got["u2"].next_due_us) == ("exhausted", "timeout", None)
    assert (got["u3"].state, got["u3"].last_error) == ("done", None)


def test_orbit_dense_and_sparse_graphs(spark):
    from fanin.operators.ordered import orbit
    # dense: ids 0..299, every id jumps to the next multiple of 10 (few distinct targets)
    dense = spark.createDataFrame([(i, (i // 10 + 1) * 10 if i < 290 else None) for i in range(300)], "id long, nxt long").withColumn("k", F.lit("x"))
    got = sorted(r.id for r in orbit(dense, spark.createDataFrame([(3, "x")], "id long, k string"), "k").collect())
    assert got == [3] + list(range(10, 300, 10))
    # sparse: a plain chain 0 -> 1 -> ... -> 99, started in the middle
    chain = spark.createDataFrame([(i, i + 1 if i < 99 else None) for i in range(100)], "id long, nxt long").withColumn("k", F.lit("x"))
    got = sorted(r.id for r in orbit(chain, spark.createDataFrame([(40, "x")], "id long, k string"), "k").collect())
    assert got == list(range(40, 100))
