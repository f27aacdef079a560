"""Source health and fetch pacing over attempt logs.

Attempt logs are ``(key, ts_us, id, ok[, error])``, ordered per key by
``(ts_us, id)``.  All of it runs as two-level scans (per key and time chunk,
then a small per-chunk carry table), as-of lookups and pointer doubling
(``fanin.operators.ordered``), so a key with a third of all rows still
spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanin.operators.ordered import (DEFAULT_TARGET_ROWS, LONG_MIN, attach_chunk, chunk_table, chunked_index,
                                     equal_rows, next_after, orbit, safe_key)
from fanin.params import FETCH_RETRIES, RETRY_BACKOFF_S, BreakerParams
from fanin.session import ensure_checkpoint_dir

US = 1_000_000


def _chunks(df: DataFrame, key: str, ts: str, chunk_us: int | None, target_rows: int):
    """A fixed width of time when given, else ranges of about ``target_rows`` rows."""
    return chunk_us if chunk_us is not None else equal_rows(df, target_rows)


def failure_streaks(attempts: DataFrame, key: str = "source", ts: str = "ts_us", rid: str = "event_id",
                    ok: str = "ok", chunk_us: int | None = None,
                    target_rows: int = DEFAULT_TARGET_ROWS, chunks=None) -> DataFrame:
    """Row 43: ``streak`` = consecutive failures ending at each attempt (0 on a success).

    streak = index - index of the last success at or before the row.  The
    last-success index is a running max inside each (key, range) and a carry of
    one row per range, so no window spans a whole key, and ranges hold equal
    rows whatever the times.  Attempts without a key form one history.
    ``chunks`` must be per ``_key`` (``safe_key``).
    """
    columns = attempts.columns
    attempts, key = attempts.withColumn("_key", safe_key(key)), "_key"
    ch = chunks if chunks is not None else _chunks(attempts, key, ts, chunk_us, target_rows)
    d = chunked_index(attempts, key, ts, rid, ch)
    run = (Window.partitionBy(key, "_c").orderBy(ts, rid)
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_ls", F.max(F.when(F.col(ok), F.col("_l"))).over(run))
    per_chunk = d.groupBy(key, "_c").agg(F.max(F.when(F.col(ok), F.col("_off") + F.col("_l"))).alias("_cls"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(key, "_c", F.max("_cls").over(before).alias("_carry"))
    d = d.join(carry, [key, "_c"], "left")
    idx = F.col("_off") + F.col("_l")
    last_ok = F.coalesce(F.col("_off") + F.col("_ls"), F.col("_carry"), F.lit(-1))
    return (d.withColumn("pos", idx.cast("bigint")).withColumn("streak", (idx - last_ok).cast("bigint"))
            .select(*columns, "pos", "streak"))


def polite_schedule(calls: DataFrame, key: str = "host", arrival: str = "arrival_us", rid: str = "event_id",
                    interval_us: int = 500_000, chunk_us: int | None = None,
                    target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Row 25: start times with consecutive calls of a key at least ``interval`` apart.

    ``t_i = max(a_i, t_{i-1} + d)`` has the closed form
    ``t_n = n*d + max_{i<=n}(a_i - i*d)``: a prefix max, computed per chunk
    with the local index and carried across chunks from the chunk table.
    """
    d_ = interval_us
    columns, calls, key = calls.columns, calls.withColumn("_key", safe_key(key)), "_key"
    x = chunked_index(calls, key, arrival, rid, _chunks(calls, key, arrival, chunk_us, target_rows))
    x = x.withColumn("_v", F.col(arrival) - F.col("_l") * F.lit(d_))
    run = (Window.partitionBy(key, "_c").orderBy(arrival, rid)
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_m", F.max("_v").over(run))
    per_chunk = x.groupBy(key, "_c").agg(F.max(F.col("_v") - F.col("_off") * F.lit(d_)).alias("_cm"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(key, "_c", F.max("_cm").over(before).alias("_carry"))
    x = x.join(carry, [key, "_c"], "left")
    n = F.col("_off") + F.col("_l")
    start = n * F.lit(d_) + F.greatest(F.col("_m") - F.col("_off") * F.lit(d_), F.col("_carry"))
    return (x.withColumn("start_us", start.cast("bigint")).withColumn("wait_us", (F.col("start_us") - F.col(arrival)))
            .select(*columns, "start_us", "wait_us"))


def retry_frontier(attempts: DataFrame, key: str = "url", ts: str = "ts_us", rid: str = "event_id",
                   ok: str = "ok", error: str = "error", max_attempts: int = FETCH_RETRIES + 1,
                   backoff_s: float = RETRY_BACKOFF_S) -> DataFrame:
    """Row 24: per key, the state after its last attempt.

    'done' (last attempt ok), 'retry' (fewer than ``max_attempts`` failures in a
    row; next due ``last_ts + backoff * failures`` -- linear), or 'exhausted'
    (carrying the last error).  Two partial aggregates: the last success per
    key, then the last attempt and the count of failures after that success.
    Attempts without a key are one key's.
    """
    at = F.struct(F.col(ts).alias("ts"), F.col(rid).alias("rid"))
    rows = attempts.withColumn("_key", safe_key(key))
    good = rows.filter(F.col(ok)).groupBy("_key").agg(F.max(at).alias("_good"))
    after = rows.join(good, "_key", "left")
    failures = F.count_if(F.col("_good").isNull() | (at > F.col("_good")))
    last = after.groupBy("_key").agg(
        F.max_by(F.struct(F.col(key).alias("key"), F.col(ok).alias("ok"), F.col(error).alias("error"), F.col(ts).alias("ts")), at).alias("_l"),
        failures.alias("streak"))
    last = last.select(F.col("_l.key").alias(key), F.struct(F.col("_l.ok").alias("ok"), F.col("streak").alias("streak"),
                                                            F.col("_l.error").alias("error"), F.col("_l.ts").alias("ts")).alias("_x"))
    state = (F.when(F.col("_x.ok"), F.lit("done"))
             .when(F.col("_x.streak") < max_attempts, F.lit("retry")).otherwise(F.lit("exhausted")))
    due = F.when(state == "retry", F.col("_x.ts") + (F.col("_x.streak") * F.lit(int(backoff_s * US))))
    return last.select(key, state.alias("state"), F.col("_x.streak").alias("failures"),
                       due.cast("bigint").alias("next_due_us"),
                       F.when(~F.col("_x.ok"), F.col("_x.error")).alias("last_error"))


def breaker_replay(attempts: DataFrame, key: str = "source", ts: str = "ts_us", rid: str = "event_id",
                   ok: str = "ok", params: BreakerParams = BreakerParams(), chunk_us: int | None = None,
                   target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Row 44: each attempt -> ``allowed``; ``opened`` marks attempts that open the breaker.

    Opens at ``threshold`` consecutive failures until ``ts + cooldown``;
    skipped attempts change nothing; a success resets; after the cool-down
    the count is kept, so the next allowed failure re-opens.

    Replay without a sequential loop: the state changes form a chain --
    from a reset (a success, or the start) the next opening is the first
    later attempt whose raw streak reaches the threshold; from an opening the
    next allowed attempt is the first one at or after ``ts + cooldown``, an
    opening again if it fails, a reset if it succeeds.  Successors are as-of
    lookups, the chain from each key's first opening is found by pointer
    doubling, and an attempt is skipped iff its time is before the latest
    ``open_until`` of the openings before it (a running max).
    """
    cd_us = int(params.cooldown_s * US)
    columns, outer = attempts.columns, key
    attempts, key = attempts.withColumn("_key", safe_key(outer)), "_key"
    if chunk_us is not None:
        ch = chunk_us
    else:   # one per-key table (a row per key) for every scan below, written once
        ensure_checkpoint_dir(attempts.sparkSession)
        ch = chunk_table(attempts, key, ts, target_rows).checkpoint(eager=True)
    s = failure_streaks(attempts.drop("_key"), outer, ts, rid, ok, chunks=ch).withColumn(
        "_flag", ~F.col(ok) & (F.col("streak") == params.threshold)).withColumn("_key", safe_key(outer))
    ensure_checkpoint_dir(s.sparkSession)
    s = s.checkpoint(eager=True)   # read five times below; also cuts lineage
    rows = s.select(key, F.col(ts).alias("ts"), F.col(rid).alias("rid"))
    flagged = s.filter("_flag").select(key, F.col(ts).alias("ts"), F.col(rid).alias("rid"))
    # first attempt at or after ts + cooldown; with no cool-down, strictly after the opening itself
    open_r = F.lit(LONG_MIN).cast("bigint") if cd_us > 0 else F.col(rid)
    after_open = next_after(rows, s.filter(~F.col(ok)).select(
        key, F.col(rid).alias("pid"), (F.col(ts) + F.lit(cd_us)).alias("t"), open_r.alias("r")),
        key, ch)
    after_reset = next_after(flagged, s.filter(F.col(ok)).select(
        key, F.col(rid).alias("pid"), F.col(ts).alias("t"), F.col(rid).alias("r")), key, ch)
    succ = after_open.unionByName(after_reset).select(key, F.col("pid").alias("id"), "nxt")
    starts = flagged.groupBy(key).agg(F.min(F.struct("ts", "rid")).alias("_f")).select(key, F.col("_f.rid").alias("id"))
    nodes = orbit(succ, starts, key).withColumn("_node", F.lit(True)).withColumnRenamed("id", rid)
    opened = s.join(nodes, [key, rid], "left")
    opened = opened.withColumn("opened", F.coalesce(F.col("_node"), F.lit(False)) & ~F.col(ok)).drop("_node")
    # latest open_until strictly before each attempt: running max per chunk plus carry
    c = attach_chunk(opened, key, F.col(ts), ch).withColumn("_ou", F.when(F.col("opened"), F.col(ts) + F.lit(cd_us)))
    prev = (Window.partitionBy(key, "_c").orderBy(ts, rid).rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_m", F.max("_ou").over(prev))
    per_chunk = c.groupBy(key, "_c").agg(F.max("_ou").alias("_cm"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(key, "_c", F.max("_cm").over(before).alias("_carry"))
    c = c.join(carry, [key, "_c"], "left")
    until = F.greatest(F.col("_m"), F.col("_carry"))
    allowed = until.isNull() | (F.col(ts) >= until)
    return (c.withColumn("allowed", allowed).withColumn("open_until_us", F.col("_ou"))
            .select(*columns, "pos", "streak", "opened", "allowed", "open_until_us"))
