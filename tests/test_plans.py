"""Plan checks: pruning and pushdown reach the scan, no Python in batch plans, top-k is partial."""

import pytest

from fanin.plans.catalog import queries

SF = "/root/testdata/sf0.001"
STREAMS = {"ttl_dedupe_stream", "breaker_stream"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - STREAMS))
def test_no_python_in_batch_plans(spark, name):
    plan = _plan(queries()[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in plan, name


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(queries()["memo_stats"](spark, SF))
    schemas = [x.split("\n")[0] for x in plan.split("ReadSchema:")[1:]]
    assert schemas and all(set(x.strip(" struct<>").replace(":bigint", "").replace(":string", "").split(",")) <= {"page_id", "url", "html"}
                           for x in schemas)
    plan = _plan(queries()["failure_streaks"](spark, SF))
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]      # events.value is never read


def test_fusion_topk_is_partial_before_shuffle(spark):
    plan = _plan(queries()["fuse_interleave_topk"](spark, SF))
    assert plan.count("WindowGroupLimit") >= 1


def test_fixed_time_range_reaches_the_scan(spark, tmp_path):
    from fanin.operators.intake import time_range_filter
    path = str(tmp_path / "res")
    spark.createDataFrame([("q", 1, 10), ("q", 2, 20)], "query_id string, pos int, published_us long") \
        .write.parquet(path)
    df = time_range_filter(spark.read.parquet(path), None, as_of_us=86_400_000_000 + 15, time_range="d")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(published_us), GreaterThanOrEqual(published_us,15)]" in plan
    assert [r.pos for r in df.collect()] == [2]
