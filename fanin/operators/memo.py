"""The TTL memo of earlier searches and fetches as a table.

A memo is a table ``key, ts_us, <payload columns>``.  Writes never modify a
table in place: ``upsert`` / ``prune`` / ``purge`` return the next snapshot,
which ``fanin.sources.sinks.write_snapshot`` writes to a new folder.
Expiry is ``as_of - ts > ttl`` with ``as_of`` a job parameter; age exactly
``ttl`` is still fresh, a future ``ts`` is fresh, a missing ``ts`` counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def _txt(c: Column) -> Column:
    """Python f-string rendering of an optional value (None -> 'None')."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def fetch_key(url: Column | str, fmt: Column | str, max_len: Column | str) -> Column:
    """Row 34: SHA-256 hex of ``fetch|url|fmt|max_len`` (UTF-8)."""
    parts = [F.col(x) if isinstance(x, str) else x for x in (url, fmt, max_len)]
    return F.sha2(F.concat_ws("|", F.lit("fetch"), *[_txt(p) for p in parts]), 256)


def search_key(query: Column | str, num_results: Column | str, time_range: Column | str,
               sources: tuple[str, ...]) -> Column:
    """Row 34: SHA-256 hex of ``search|query|n|time_range|s1,s2,...``."""
    parts = [F.col(x) if isinstance(x, str) else x for x in (query, num_results, time_range)]
    return F.sha2(F.concat_ws("|", F.lit("search"), *[_txt(p) for p in parts], F.lit(",".join(sources))), 256)


def expired(ts_us: Column, as_of_us: int, ttl_s: int) -> Column:
    return (F.lit(as_of_us) - F.coalesce(ts_us, F.lit(0))) > F.lit(ttl_s * US)


def split(requests: DataFrame, memo: DataFrame, as_of_us: int, ttl_s: int,
          payload: tuple[str, ...] = ("status", "content")) -> DataFrame:
    """Row 35: requests (with ``key``) -> every request with ``cached`` and, for hits, the payload.

    Expired entries are filtered on the memo side before the join, so only
    fresh entries are shuffled.  The work list is ``filter(~cached)``.
    """
    fresh = memo.filter(~expired(F.col("ts_us"), as_of_us, ttl_s)).select(
        "key", F.lit(True).alias("_hit"), *[F.col(c).alias(f"memo_{c}") for c in payload])
    return (requests.join(fresh, "key", "left")
            .withColumn("cached", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


def admit_fetches(resolved: DataFrame) -> DataFrame:
    """Row 36: only fetches with status 200 and non-empty content are remembered."""
    return resolved.filter((F.col("status") == 200) & (F.coalesce(F.col("content"), F.lit("")) != ""))


def admit_searches(fused_status: DataFrame) -> DataFrame:
    """Row 36: every result set that did not error is remembered (also empty or partial)."""
    return fused_status.filter(F.col("status") != "error")


RESULT_FIELDS = ("rank", "title", "href", "body", "source", "published_us")


def result_sets(fused: DataFrame, admitted: DataFrame, used: DataFrame) -> DataFrame:
    """Row 36, searches: ``(query_id, results, sources_used)``, one set per admitted query, its rows in rank order.

    ``admitted(query_id)`` may hold queries without rows (an empty set is remembered too), ``used`` the sources that
    answered.  A set is bounded by its query's number of results."""
    fields = [f for f in RESULT_FIELDS if f in fused.columns]
    sets = fused.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))
    none = F.array().cast(sets.schema["results"].dataType)
    return (admitted.select("query_id").join(sets, "query_id", "left").join(used.select("query_id", "sources_used"), "query_id", "left")
            .select("query_id", F.coalesce("results", none).alias("results"), F.coalesce("sources_used", F.lit("")).alias("sources_used")))


def upsert(memo: DataFrame, new: DataFrame) -> DataFrame:
    """Row 37: last write per key wins (by ts, then new over old).

    ``max_by`` is a partial aggregate, so repeated keys combine before the
    shuffle.
    """
    cols = [c for c in memo.columns if c != "key"]
    both = (memo.withColumn("_gen", F.lit(0))
            .unionByName(new.select("key", *cols).withColumn("_gen", F.lit(1))))
    win = F.max_by(F.struct(*cols), F.struct(F.coalesce(F.col("ts_us"), F.lit(0)), F.col("_gen")))
    return both.groupBy("key").agg(win.alias("_w")).select("key", "_w.*")


def prune(memo: DataFrame, max_entries: int, groups: int = 64) -> DataFrame:
    """Row 38: keep the newest ``max_entries`` (ties by key).

    A two-level top-n on the narrow ``(key, ts_us)`` projection: keys are
    hashed into ``groups``; a per-group ``row_number() <= n`` (planned as a
    partial ``WindowGroupLimit`` ahead of the shuffle) leaves at most
    ``groups * n`` candidates, and the final top-n merges only those -- never
    ``n`` rows from every input partition in one task.  The payload is kept
    through a semi join.
    """
    order = [F.col("ts_us").desc_nulls_last(), F.col("key")]
    g = F.pmod(F.xxhash64("key"), F.lit(groups))
    w = Window.partitionBy("_g").orderBy(*order)
    cand = (memo.select("key", "ts_us", g.alias("_g")).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= max_entries))
    keep = cand.orderBy(*order).limit(max_entries)
    return memo.join(keep.select("key"), "key", "left_semi")


def purge(memo: DataFrame, as_of_us: int | None = None, ttl_s: int | None = None,
          delete_keys: DataFrame | None = None, clear: bool = False) -> DataFrame:
    """Row 39: drop expired entries, drop the given keys, or clear."""
    out = memo
    if clear:
        return out.limit(0)
    if as_of_us is not None and ttl_s is not None:
        out = out.filter(~expired(F.col("ts_us"), as_of_us, ttl_s))
    if delete_keys is not None:
        out = out.join(delete_keys.select("key"), "key", "left_anti")
    return out


def stats(memo: DataFrame, as_of_us: int, size_of: Column | None = None) -> DataFrame:
    """Row 40: entries, size_bytes, oldest_age_s, newest_age_s (ages 0 when empty)."""
    size = size_of if size_of is not None else F.octet_length(F.coalesce(F.col("content"), F.lit("")))
    age = (F.lit(as_of_us) - F.col("ts_us")) / F.lit(float(US))
    return memo.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.coalesce(F.max(age), F.lit(0.0)).alias("oldest_age_s"),
        F.coalesce(F.min(age), F.lit(0.0)).alias("newest_age_s"))


def ttl_replay(log: DataFrame, ttl_s: int, key: str = "req_key", ts: str = "ts_us", rid: str = "event_id",
               chunk_us: int | None = None, target_rows: int | None = None) -> DataFrame:
    """Row 41: over a request log, which requests would have been memo hits.

    Per key in ``(ts, id)`` order: a miss stamps the entry; a request is a hit
    while ``ts - stamp <= ttl``; hits do not re-stamp.  A request more than the
    TTL after the one before it is always a miss, so a key's history falls into
    independent segments there.  Inside a segment the misses are the chain
    first request -> first request with ``ts > stamp + ttl`` -> ..., found with
    an as-of lookup and pointer doubling over the segments at once (no per-key
    list, no sequential loop); every other request is a hit.  Rows are told
    apart by key and id together; rows without a key form one history.
    """
    from fanin.operators.ordered import (DEFAULT_TARGET_ROWS, LONG_MAX, equal_rows, next_after, orbit,
                                         previous_ts, safe_key)

    if ttl_s < 0:   # every request is older than the entry it would read
        return log.withColumn("hit", F.lit(False))
    ttl_us = ttl_s * US
    log = log.withColumn("_key", safe_key(key))
    rows = log.select("_key", F.col(ts).alias("ts"), F.col(rid).alias("rid"))
    chunk = chunk_us if chunk_us is not None else equal_rows(rows, target_rows or DEFAULT_TARGET_ROWS)
    gaps = previous_ts(rows, "_key", chunk)
    starts = gaps.filter(F.col("prev").isNull() | (F.col("ts") - F.col("prev") > ttl_us)).select("_key", F.col("rid").alias("id"))
    probes = rows.select("_key", F.col("rid").alias("pid"), (F.col("ts") + F.lit(ttl_us)).alias("t"),
                         F.lit(LONG_MAX).cast("bigint").alias("r"))
    succ = next_after(rows, probes, "_key", chunk).filter(F.col("nxt").isNotNull())
    succ = succ.join(starts.withColumnRenamed("id", "nxt"), ["_key", "nxt"], "left_anti")    # chains end with their segment
    misses = orbit(succ.select("_key", F.col("pid").alias("id"), "nxt"), starts, "_key").withColumn("_miss", F.lit(True))
    out = log.join(misses.withColumnRenamed("id", rid), ["_key", rid], "left")
    return out.withColumn("hit", F.col("_miss").isNull()).select(*[c for c in log.columns if c != "_key"], "hit")
