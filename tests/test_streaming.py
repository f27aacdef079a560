import os
import tempfile
import time

from pyspark.sql import functions as F

from fanin.operators import health as HE
from fanin.operators import memo as ME
from fanin.params import BreakerParams
from fanin.streaming import stateful as ST

SF = "/root/testdata/sf0.001"


import pytest


@pytest.mark.parametrize("api", ["transform", "apply"])
def test_multi_batch_parity_with_batch_replays(spark, api):
    ev = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    src = tempfile.mkdtemp(prefix="fanin-stream-src-")
    # several files in event-time order, written one after another (the file source
    # orders new files by modification time), one file per micro-batch
    lo, hi = ev.agg(F.min("event_id"), F.max("event_id")).first()
    edges = [lo - 1 + (hi - lo + 1) * i // 4 for i in range(4)] + [hi]
    for i in range(4):
        part = ev.filter((F.col("event_id") > edges[i]) & (F.col("event_id") <= edges[i + 1])).coalesce(1)
        part.write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
        time.sleep(1.1)
    files = [os.path.join(src, f"part{i}", f) for i in range(4) for f in sorted(os.listdir(os.path.join(src, f"part{i}")))
             if f.endswith(".parquet")]
    flat = tempfile.mkdtemp(prefix="fanin-stream-flat-")
    for i, f in enumerate(files):
        with open(f, "rb") as a, open(os.path.join(flat, f"b{i}.parquet"), "wb") as b:
            b.write(a.read())
        os.utime(os.path.join(flat, f"b{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    src = flat
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = ST.with_ts(stream.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type").alias("req_key"), "ts"))
    got = ST.run_to_tables(spark, ST.ttl_dedupe_stream(log, 21600, "1 day"), "t-ttl")[0]
    batch_log = ST.with_ts(ev.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type").alias("req_key"), "ts"))
    exp = ME.ttl_replay(batch_log.select("event_id", "req_key", "ts_us"), 21600)
    assert got.select("event_id", "hit").exceptAll(exp.select("event_id", "hit")).count() == 0
    assert got.count() == ev.count()

    att_stream = ST.with_ts(stream.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
                                          "ts", (F.col("event_type") != "error").alias("ok")))
    p = BreakerParams(threshold=2, cooldown_s=86400)
    got_b = ST.run_to_table(spark, ST.breaker_stream(att_stream, p, "1 day", api=api), "t-br")
    att = ST.with_ts(ev.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "ts",
                               (F.col("event_type") != "error").alias("ok")))
    exp_b = HE.breaker_replay(att.select("event_id", "source", "ts_us", "ok"), params=p)
    cols = ["event_id", "allowed", "opened"]
    assert got_b.select(*cols).exceptAll(exp_b.select(*cols)).count() == 0
    assert os.path.isdir(src)


def _log_files(rows_by_batch):
    """One Parquet file per micro-batch, in this order."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    src = tempfile.mkdtemp(prefix="fanin-late-")
    for i, rows in enumerate(rows_by_batch):
        ids, keys, ts = (list(c) for c in zip(*rows, strict=True))
        path = os.path.join(src, f"b{i}.parquet")
        pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "req_key": keys, "ts": pa.array([t * 1_000_000 for t in ts], pa.timestamp("us", "UTC"))}), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return src


def test_every_row_is_in_time_or_late(spark):
    import random

    rng, day, delay, ttl = random.Random(2), 1_704_067_200, 600, 300
    batches, n = [], 0
    for b in range(5):
        rows = []
        for _ in range(120):
            back = rng.choice([0, 0, 0, 0, 200, 500, 900, 5000])        # some within the delay, some beyond
            rows.append((n, rng.choice("abc"), day + b * 1000 + rng.randint(0, 999) - back))
            n += 1
        batches.append(rows)
    stream = spark.readStream.schema("event_id long, req_key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(_log_files(batches))
    in_time, late = ST.run_to_tables(spark, ST.ttl_dedupe_stream(ST.with_ts(stream), ttl, f"{delay} seconds"), "t-late")
    got = {r.event_id: r.hit for r in in_time.collect()}
    gone = {r.event_id for r in late.collect()}
    # the watermark of a micro-batch is the latest time of all batches before it, less the delay
    want, want_late, stamps, top = {}, set(), {}, None
    for rows in batches:
        mark = 0 if top is None else top - delay
        for i, key, t in sorted(rows, key=lambda r: (r[2], r[0])):
            if t < mark:
                want_late.add(i)
                continue
            want[i] = key in stamps and t - stamps[key] <= ttl
            if not want[i]:
                stamps[key] = t
        top = max([top or 0, *(r[2] for r in rows)])
    assert len(want_late) > 20 and gone == want_late and got == want
    assert len(got) + len(gone) == n


def test_a_hot_key_is_folded_by_its_times_alone():
    import tracemalloc

    import numpy as np

    times = np.arange(2_000_000, dtype=np.int64) * 700
    tracemalloc.start()
    hits, stamp = ST.ttl_hits(times, None, 1_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(times) and not hits[0] and (~hits).sum() == 1 + (len(times) - 1) // 1429 and stamp == times[~hits][-1]
    assert ST.ttl_hits(np.array([5, 6]), 100, 10)[0].all()              # a stamp ahead of a request still serves it


class _Handle:
    """A processor's handle that counts the calls to the state store."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)

    def registerTimer(self, t):
        self.calls += 1
        self.timers.append(t)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _ttl_call(p, rows, mark_s=0):
    import pandas as pd

    frames = [pd.DataFrame(part, columns=["event_id", "req_key", "ts_us"]) for part in (rows[:len(rows) // 2], rows[len(rows) // 2:]) if part]
    return pd.concat(list(p.handleInputRows((0,), iter(frames), _Mark(mark_s * 1000))))


def test_a_bucket_of_many_keys_is_one_round_of_state_calls():
    import pandas as pd

    handle, us = _Handle(), 1_000_000
    p = ST.TtlProcessor(10 * us)
    p.init(handle)
    keys = [f"k{i}" for i in range(3000)] + [None]
    first = _ttl_call(p, [(i, k, 100 * us) for i, k in enumerate(keys)])
    assert not first["hit"].any() and sorted(first["req_key"], key=str) == sorted(keys, key=str) and handle.calls < 10
    second = _ttl_call(p, [(i, k, (110 if i % 2 else 111) * us) for i, k in enumerate(keys)], 100)
    assert dict(zip(second["event_id"], second["hit"])) == {i: bool(i % 2) for i in range(len(keys))}
    assert handle.calls < 20 and handle.timers == [121_001]
    third = _ttl_call(p, [(9, "k9", 110 * us), (10, "k10", 112 * us)], 112)       # one late; stamps of 100 s can serve nobody
    assert dict(zip(third["event_id"], third["late"])) == {9: True, 10: False} and dict(zip(third["event_id"], third["hit"])) == {9: False, 10: True}
    assert set(handle.value[1]) == {111 * us} and len(handle.value[0]) == 1501
    list(p.handleExpiredTimer((0,), None, None))
    assert handle.value is None

    handle = _Handle()
    b = ST.BreakerProcessor(2, 50)
    b.init(handle)
    rows = pd.DataFrame([(i, f"s{i % 1000}", i // 1000, i % 1000 == 7) for i in range(2000)], columns=["event_id", "source", "ts_us", "ok"])
    got = pd.concat(list(b.handleInputRows((0,), iter([rows[:900], rows[900:]]), _Mark(0)))).set_index("event_id").sort_index()
    assert handle.calls < 10 and got["allowed"].all() and got["opened"].sum() == 999 and not got["opened"][[7, 1007]].any()
    assert len(handle.value[0]) == 999 and "s7" not in handle.value[0]
    more = pd.DataFrame([(3000, "s1", 50, True), (3001, "s2", 51, True)], columns=["event_id", "source", "ts_us", "ok"])
    got = pd.concat(list(b.handleInputRows((0,), iter([more]), _Mark(0)))).set_index("event_id")
    assert not got["allowed"][3000] and got["allowed"][3001] and "s2" not in handle.value[0]


def test_keys_that_share_a_bucket_do_not_meet(spark):
    import random

    rng, day, ttl = random.Random(5), 1_704_067_200, 300
    batches, n = [], 0
    for b in range(3):
        rows = [(n + i, rng.choice([None, *(f"k{k}" for k in range(40))]), day + b * 400 + rng.randint(0, 399)) for i in range(400)]
        n += len(rows)
        batches.append(rows)
    stream = spark.readStream.schema("event_id long, req_key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(_log_files(batches))
    in_time, late = ST.run_to_tables(spark, ST.ttl_dedupe_stream(ST.with_ts(stream), ttl, "1 day", buckets=3), "t-bucket")
    want, stamps = {}, {}
    for i, key, t in sorted((r for rows in batches for r in rows), key=lambda r: (r[2], r[0])):
        want[i] = key, key in stamps and t - stamps[key] <= ttl
        if not want[i][1]:
            stamps[key] = t
    assert {r.event_id: (r.req_key, r.hit) for r in in_time.collect()} == want and not late.count()
