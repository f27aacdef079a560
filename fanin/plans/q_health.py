"""Registered queries for order-dependent state: retries, pacing, streaks, breaker, TTL replay
(SURVEY rows 24, 25, 41, 43, 44)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fanin.functions.times import epoch_micros
from fanin.functions.urls import with_result_domain
from fanin.operators import health as HE
from fanin.operators import memo as ME
from fanin.params import BreakerParams
from fanin.plans import sqlx as X
from fanin.plans.q_search import Ctx
from fanin.plans.registry import register
from fanin.sources import fixtures as fx

BREAKER = BreakerParams(threshold=2, cooldown_s=86400)   # the defaults 3 / 30 s never skip on this data
POLITE_US = 600 * 1_000_000
TTL_S = 21600


def attempts(c: Ctx):
    return c.v("attempts").select("event_id", "source", epoch_micros("ts").alias("ts_us"), "ok")


def fetch_attempts(c: Ctx):
    return c.v("fetch_attempts").select("event_id", "url", epoch_micros("ts").alias("ts_us"), "ok", "error")


ATT = ("att", "SELECT event_id, source, epoch_us(ts) AS ts_us, ok FROM attempts")
FATT = ("fatt", "SELECT event_id, url, epoch_us(ts) AS ts_us, ok, error FROM fetch_attempts")
STREAK = """SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY {k}, grp ORDER BY ts_us, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS streak
FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY ts_us, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM {src}) g"""


@register("failure_streaks", fx.duckdb_with("attempts", ctes=[ATT, ("st", STREAK.format(k="source", src="att"))]) +
          "SELECT event_id, source, ts_us, ok, streak FROM st")
def q_failure_streaks(spark, sf):
    return HE.failure_streaks(attempts(Ctx(spark, sf))).select("event_id", "source", "ts_us", "ok", "streak")


@register("retry_frontier", fx.duckdb_with("fetch_attempts", ctes=[FATT, ("st", STREAK.format(k="url", src="fatt"))]) + """
SELECT url, CASE WHEN ok THEN 'done' WHEN streak < 3 THEN 'retry' ELSE 'exhausted' END AS state, streak AS failures,
       CASE WHEN NOT ok AND streak < 3 THEN ts_us + streak * 1500000 END AS next_due_us,
       CASE WHEN NOT ok THEN error END AS last_error
FROM st QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts_us DESC, event_id DESC) = 1""")
def q_retry_frontier(spark, sf):
    return HE.retry_frontier(fetch_attempts(Ctx(spark, sf)))


@register("polite_schedule", fx.duckdb_with("fetch_attempts", ctes=[FATT, ("h", X.domain_rel("SELECT * FROM fatt", "url", "host"))]) + f"""
SELECT host, event_id, ts_us AS arrival_us, start_us, start_us - ts_us AS wait_us FROM (
  SELECT *, CAST(n * {POLITE_US} + max(ts_us - n * {POLITE_US}) OVER (PARTITION BY host ORDER BY ts_us, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS start_us
  FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts_us, event_id) - 1 AS n FROM h) x) y""")
def q_polite_schedule(spark, sf):
    calls = with_result_domain(fetch_attempts(Ctx(spark, sf)), "url", "host").select(
        "host", "event_id", F.col("ts_us").alias("arrival_us"))
    return HE.polite_schedule(calls, "host", "arrival_us", "event_id", POLITE_US).select(
        "host", "event_id", "arrival_us", "start_us", "wait_us")


@register("ttl_replay", fx.duckdb_with("request_log", ctes=[("o", """
SELECT event_id, req_key, epoch_us(ts) AS ts_us,
       row_number() OVER (PARTITION BY req_key ORDER BY epoch_us(ts), event_id) AS rn FROM request_log""")]) + f"""
, st AS (
  WITH RECURSIVE walk(req_key, rn, stamp, hit) AS (
    SELECT req_key, rn, ts_us, false FROM o WHERE rn = 1
    UNION ALL
    SELECT o.req_key, o.rn, CASE WHEN o.ts_us - w.stamp > {TTL_S * 1_000_000} THEN o.ts_us ELSE w.stamp END,
           NOT (o.ts_us - w.stamp > {TTL_S * 1_000_000})
    FROM walk w JOIN o ON o.req_key = w.req_key AND o.rn = w.rn + 1)
  SELECT * FROM walk)
SELECT o.event_id, o.req_key, o.ts_us, st.hit FROM o JOIN st ON st.req_key = o.req_key AND st.rn = o.rn""")
def q_ttl_replay(spark, sf):
    log = Ctx(spark, sf).v("request_log").select("event_id", "req_key", epoch_micros("ts").alias("ts_us"))
    return ME.ttl_replay(log, TTL_S).select("event_id", "req_key", "ts_us", "hit")


_TH, _CD = BREAKER.threshold, int(BREAKER.cooldown_s * 1_000_000)


@register("breaker_replay", fx.duckdb_with("attempts", ctes=[ATT, ("o", """
SELECT event_id, source, ts_us, ok, row_number() OVER (PARTITION BY source ORDER BY ts_us, event_id) AS rn FROM att""")]) + f"""
, st AS (
  WITH RECURSIVE walk(source, rn, fails, open_until, allowed, opened) AS (
    SELECT source, rn, CASE WHEN ok THEN 0 ELSE 1 END,
           CASE WHEN NOT ok AND 1 >= {_TH} THEN ts_us + {_CD} END, true, NOT ok AND 1 >= {_TH}
    FROM o WHERE rn = 1
    UNION ALL
    SELECT o.source, o.rn,
      CASE WHEN w.open_until IS NOT NULL AND o.ts_us < w.open_until THEN w.fails WHEN o.ok THEN 0 ELSE w.fails + 1 END,
      CASE WHEN w.open_until IS NOT NULL AND o.ts_us < w.open_until THEN w.open_until WHEN o.ok THEN NULL
           WHEN w.fails + 1 >= {_TH} THEN o.ts_us + {_CD} ELSE w.open_until END,
      NOT (w.open_until IS NOT NULL AND o.ts_us < w.open_until),
      NOT (w.open_until IS NOT NULL AND o.ts_us < w.open_until) AND NOT o.ok AND w.fails + 1 >= {_TH}
    FROM walk w JOIN o ON o.source = w.source AND o.rn = w.rn + 1)
  SELECT * FROM walk)
SELECT o.event_id, o.source, o.ts_us, st.allowed, st.opened FROM o JOIN st ON st.source = o.source AND st.rn = o.rn""")
def q_breaker_replay(spark, sf):
    out = HE.breaker_replay(attempts(Ctx(spark, sf)), params=BREAKER)
    return out.select("event_id", "source", "ts_us", "allowed", "opened")
