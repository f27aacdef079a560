"""Streaming forms of the TTL replay and the circuit breaker.

The folds are ``transformWithStateInPandas`` processors.  A call of one costs some ms of round trips to the state store
whatever it folds, so rows are grouped by ``BUCKETS`` hash buckets of keys, not by key: a micro-batch makes at most that many
calls, however many keys it has.  A bucket's state is one value that holds its live keys, each with the state of its fold;
the keys themselves tell rows apart, so keys that share a bucket do not meet.  A micro-batch rewrites the live keys of the
buckets it touches.

For the TTL fold a key's state is the stamp of its last miss.  The caller names the watermark's delay.  A row that comes when the watermark has passed its time is late: it is not folded
but given out with ``late = true``, so that every input row is in one of the two outputs of ``run_to_tables``.  Spark
drops late rows before a processor only where the watermarked column reaches it; it does not here, and the processor
reads the watermark itself.  A stamp is dropped once the watermark is past ``stamp + ttl``, when no on-time request can hit
it: at its bucket's next rows, or by an event-time timer when that holds for the whole bucket.

Inside a micro-batch a key's rows are folded in order of ``(ts, id)`` whatever batches they come in: only the numbers of a
bucket's rows and its keys are held, 20 bytes a row, the fold jumps from miss to miss by binary search, and rows go out in slices.  For input in
event-time order this equals the batch replay in ``fanin.operators.memo.ttl_replay``.  A micro-batch is bounded by the
source's ``maxFilesPerTrigger`` (``file_stream``), which bounds a hot key's rows in it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fanin.params import BreakerParams
from fanin.session import scratch_path

US = 1_000_000

TTL_OUT = "event_id long, req_key string, ts_us long, hit boolean, late boolean"
TTL_STATE = "keys array<string>, stamps_us array<long>"
BREAKER_OUT = "event_id long, source string, ts_us long, allowed boolean, opened boolean"
BREAKER_STATE = "fails long, open_until_us long"
BREAKERS_STATE = "sources array<string>, fails array<long>, open_until_us array<long>"

BUCKETS = 2048                       # groups of keys, each folded by one call in a micro-batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


SLICE = 50_000                       # rows given out at once


def ttl_hits(times: np.ndarray, stamp: int | None, ttl_us: int) -> tuple[np.ndarray, int | None]:
    """Which of a key's sorted requests hit, and its stamp after them: from each miss straight to the next."""
    hits = np.ones(len(times), dtype=bool)
    at = 0 if stamp is None else int(np.searchsorted(times, stamp + ttl_us, side="right"))
    while at < len(times):
        hits[at], stamp = False, int(times[at])
        at = max(at + 1, int(np.searchsorted(times, stamp + ttl_us, side="right")))
    return hits, stamp


def _breaker_fold(times: np.ndarray, oks: np.ndarray, fails: int, until: int | None, th: int, cd_us: int):
    allowed, opened = [], []
    for t, ok in zip(times, oks):
        if until is not None and t < until:
            allowed.append(False)
            opened.append(False)
            continue
        allowed.append(True)
        if ok:
            fails, until = 0, None
            opened.append(False)
        else:
            fails += 1
            if fails >= th:
                until = int(t) + cd_us
            opened.append(bool(fails >= th))
    return allowed, opened, fails, until


def by_bucket(rows: DataFrame, key: str, buckets: int) -> GroupedData:
    """``rows`` grouped by hash bucket of ``key``; null is a key like any other."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).groupBy("bucket")


class Numbered(dict):
    """Numbers keys in the order they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n

    def of(self, keys: pd.Series) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int32, len(keys))

    def names(self) -> np.ndarray:
        out = np.empty(len(self), dtype=object)
        out[:] = list(self)
        return out


def runs(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(code, first, end) of each run of equal codes."""
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(codes[a]), a, b


class TtlProcessor(StatefulProcessor):
    """Value state: a bucket's live keys and the stamps of their last misses.  Late rows pass by it."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stamps", TTL_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known, codes, times, ids = Numbered(), [], [], []
        for pdf in rows:
            codes.append(known.of(pdf["req_key"]))
            times.append(pdf["ts_us"].to_numpy(np.int64))
            ids.append(pdf["event_id"].to_numpy(np.int64))
        codes, times, ids = np.concatenate(codes), np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((ids, times, codes))
        codes, times, ids = codes[order], times[order], ids[order]
        names = known.names()
        late = times < passed                                             # rows before the watermark
        hits = np.zeros(len(times), dtype=bool)
        if not late.all():
            held = self.state.get()
            stamps = dict(zip(*held, strict=True)) if held else {}
            for code, a, b in runs(codes):
                a += int(np.searchsorted(times[a:b], passed, side="left"))
                if a < b:
                    hits[a:b], stamps[names[code]] = ttl_hits(times[a:b], stamps.get(names[code]), self.ttl_us)
            stamps = {k: s for k, s in stamps.items() if s + self.ttl_us >= passed}
            self.state.update((list(stamps), list(stamps.values())))
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer((max(stamps.values()) + self.ttl_us) // 1000 + 1)
        for a in range(0, len(times), SLICE):
            b = min(a + SLICE, len(times))
            yield pd.DataFrame({"event_id": ids[a:b], "req_key": names[codes[a:b]], "ts_us": times[a:b], "hit": hits[a:b], "late": late[a:b]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()      # no on-time request can hit any of these entries any more
        return iter([])

    def close(self) -> None:
        pass


class BreakerProcessor(StatefulProcessor):
    """Value state: a bucket's sources with consecutive failures and open-until; one closed with nothing counted is left out."""

    def __init__(self, threshold: int, cooldown_us: int):
        self.th, self.cd_us = threshold, cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breakers", BREAKERS_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        breakers = {k: (n, until) for k, n, until in zip(*held, strict=True)} if held else {}
        known, codes, times, ids, oks = Numbered(), [], [], [], []
        for pdf in rows:
            codes.append(known.of(pdf["source"]))
            times.append(pdf["ts_us"].to_numpy())
            ids.append(pdf["event_id"].to_numpy())
            oks.append(pdf["ok"].to_numpy())
        codes, times, ids, oks = (np.concatenate(x) for x in (codes, times, ids, oks))
        order = np.lexsort((ids, times, codes))
        codes, times, ids, oks = codes[order], times[order], ids[order], oks[order]
        names = known.names()
        allowed, opened = [], []
        for code, a, b in runs(codes):
            one = names[code]
            yes, trips, fails, until = _breaker_fold(times[a:b], oks[a:b], *breakers.pop(one, (0, None)), self.th, self.cd_us)
            allowed += yes
            opened += trips
            if fails or until is not None:
                breakers[one] = (int(fails), until)
        if breakers:
            self.state.update((list(breakers), [n for n, _ in breakers.values()], [until for _, until in breakers.values()]))
        else:
            self.state.clear()
        for a in range(0, len(times), SLICE):
            b = min(a + SLICE, len(times))
            yield pd.DataFrame({"event_id": ids[a:b], "source": names[codes[a:b]], "ts_us": times[a:b],
                                "allowed": allowed[a:b], "opened": opened[a:b]})

    def close(self) -> None:
        pass


def ttl_dedupe_stream(log: DataFrame, ttl_s: int, watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """Row 42: streaming ``(event_id, req_key, ts_us, ts)`` -> the same rows with ``hit`` and ``late``.

    ``watermark`` is how far behind the latest row seen a row may come and still be folded.  A call holds the live keys and
    the micro-batch's rows of one of the ``buckets``, a number that is fixed for the life of a checkpoint."""
    rows = log.withWatermark("ts", watermark).select("event_id", "req_key", "ts_us")
    return by_bucket(rows, "req_key", buckets).transformWithStateInPandas(TtlProcessor(ttl_s * US), TTL_OUT, "Append", "EventTime")


def breaker_stream(attempts: DataFrame, params: BreakerParams, watermark: str, api: str = "transform", buckets: int = BUCKETS) -> DataFrame:
    """Row 45: streaming ``(event_id, source, ts_us, ok, ts)`` -> ``allowed`` / ``opened`` per attempt."""
    th, cd_us = params.threshold, int(params.cooldown_s * US)
    if api == "transform":
        return (by_bucket(attempts.withWatermark("ts", watermark), "source", buckets)
                .transformWithStateInPandas(BreakerProcessor(th, cd_us), BREAKER_OUT, "Append", "EventTime"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fails, until = state.get if state.exists else (0, None)
        pdf = pd.concat(list(batches)).sort_values(["ts_us", "event_id"], kind="stable")
        allowed, opened, fails, until = _breaker_fold(pdf["ts_us"].to_numpy(), pdf["ok"].to_numpy(), fails, until, th, cd_us)
        if fails == 0 and until is None:
            state.remove()          # closed and nothing counted: same as no state
        else:
            state.update((int(fails), until))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "source": key[0], "ts_us": pdf["ts_us"].to_numpy(),
                            "allowed": allowed, "opened": opened})

    return (attempts.withWatermark("ts", watermark).groupBy("source")
            .applyInPandasWithState(fold, BREAKER_OUT, BREAKER_STATE, "append", GroupStateTimeout.NoTimeout))


def run_to_tables(spark: SparkSession, stream: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """As ``run_to_table`` for a stream with a column ``late``: the rows that came in time, and the late ones."""
    out = run_to_table(spark, stream, name, ("late",))
    return out.filter("not late").drop("late"), out.filter("late").drop("late", "hit")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over everything available now into a Parquet table in the shared
    checkpoint folder (fresh sink and checkpoint per run) and read it back.

    ``transformWithState`` needs the RocksDB state store; when the session names
    no provider, it is set for this query's start only (a query keeps the
    provider it started with) and the setting is restored afterwards.
    """
    base = scratch_path(spark, name)
    before = spark.conf.get(PROVIDER_CONF, None)
    if before is None:
        spark.conf.set(PROVIDER_CONF, ROCKSDB)
    try:
        q = (stream.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by)
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_CONF)
    q.awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).parquet(f"{base}/out")


def file_stream(spark: SparkSession, path: str, schema, max_files: int) -> DataFrame:
    """A folder of Parquet files as a stream; ``max_files`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def in_time_slices(df: DataFrame, ts: str, slices: int, name: str, files: int = 2) -> str:
    """Write a table as a log that grew: ``slices`` appends of equal spans of time, of ``files`` files each; its folder."""
    path = scratch_path(df.sparkSession, name)
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    if lo is None:
        df.write.parquet(path)
        return path
    edges = [lo + (hi - lo) * k / slices for k in range(1, slices)]
    for k in range(slices):
        part = df if slices == 1 else df.filter(F.col(ts) < edges[k]) if k == 0 else df.filter(F.col(ts) >= edges[k - 1])
        part = part if k in (0, slices - 1) else part.filter(F.col(ts) < edges[k])
        part.repartition(files, ts).write.mode("append").parquet(path)
    return path


def with_ts(df: DataFrame) -> DataFrame:
    """Event-time column as TIMESTAMP (watermarks need it) next to epoch micros."""
    from fanin.functions.times import epoch_micros
    return df.withColumn("ts_us", epoch_micros("ts")).withColumn("ts", F.col("ts").cast("timestamp"))


# The folds and processors run in Python workers.  Pickled by value, they need only
# pandas there, not this package on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
