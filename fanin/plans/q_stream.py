"""Registered streaming queries: the driver tables as file
streams, run with ``availableNow`` into Parquet, compared with the batch oracles."""

from __future__ import annotations

from fanin.plans.q_health import BREAKER, TTL_S
from fanin.plans.registry import ORACLES, register
from fanin.sources import fixtures as fx
from fanin.streaming import stateful as ST


SLICES = 4                  # micro-batches of the registered runs
WATERMARK = "1 day"


def _stream_view(spark, sf, name):
    """The events as a log of ``SLICES`` appends, read one append per micro-batch."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    path = ST.in_time_slices(events, "ts", SLICES, "event-log")
    return ST.with_ts(fx.view(spark, sf, name, {"events": ST.file_stream(spark, path, events.schema, 2)}))


@register("ttl_dedupe_stream", ORACLES["ttl_replay"])
def q_ttl_dedupe_stream(spark, sf):
    in_time, _ = ST.run_to_tables(spark, ST.ttl_dedupe_stream(_stream_view(spark, sf, "request_log"), TTL_S, WATERMARK), "ttl_stream")
    return in_time.select("event_id", "req_key", "ts_us", "hit")


@register("breaker_stream", ORACLES["breaker_replay"])
def q_breaker_stream(spark, sf):
    att = _stream_view(spark, sf, "attempts")
    return ST.run_to_table(spark, ST.breaker_stream(att, BREAKER, WATERMARK), "breaker_stream").select(
        "event_id", "source", "ts_us", "allowed", "opened")
