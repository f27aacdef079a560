from pyspark.sql import functions as F

from fanin.operators import intake as IN
from fanin.params import QUERY_ERROR, TIME_RANGE_ERROR


def test_validate_rejects_blank_and_bad_range(spark):
    df = spark.createDataFrame([("1", "   ", ""), ("2", "ok", "x"), ("3", " q ", " D "), ("4", None, None),
                                ("5", "q", None)], "query_id string, query string, time_range string")
    got = {r.query_id: r for r in IN.validate(df).collect()}
    assert got["1"].reject_reason == QUERY_ERROR and not got["1"].accepted
    assert got["2"].reject_reason == TIME_RANGE_ERROR
    assert got["3"].accepted and got["3"].query == "q" and got["3"].time_range == "d"
    assert got["4"].reject_reason == QUERY_ERROR
    assert got["5"].accepted and got["5"].time_range == ""


def test_clamp(spark):
    vals = ["1000000", "abc", None, "0", "-5", "3.9", "201", " 42 ", "1e3", "nan", "Infinity", "99999999999999999999999"]
    df = spark.createDataFrame([(str(i), v, v) for i, v in enumerate(vals)],
                               "query_id string, num_results string, max_content_length string")
    research = {r.query_id: (r.num_results, r.max_content_length) for r in IN.clamp(df, "research").collect()}
    search = {r.query_id: r.num_results for r in IN.clamp(df, "search").collect()}
    n = [research[str(i)][0] for i in range(len(vals))]
    assert n == [200, 15, 15, 1, 1, 3, 200, 42, 200, 15, 15, 200]
    assert search["2"] == 20 and search["1"] == 15          # absent vs invalid
    m = [research[str(i)][1] for i in range(len(vals))]
    assert m[0] == 500000 and m[1] == 20000 and m[3] == 500 and m[7] == 500


def test_time_range_cutoffs():
    cut = IN.time_range_cutoffs(1709251200000000)           # 2024-03-01
    assert cut["m"] == 1706745600000000                      # 2024-02-01
    assert IN.months_back(1711843200000000, 1) == 1709164800000000   # 03-31 -> 02-29


def test_page_early_stop_and_budget(spark):
    rows = [("q", p, i) for p in (1, 2, 3, 6, 7) for i in range(2)] + [("r", p, 0) for p in (2, 3)]
    items = spark.createDataFrame(rows, "query_id string, page_no int, pos int")
    req = spark.createDataFrame([("q", 140), ("r", 100)], "query_id string, num_results int")
    kept = IN.page_early_stop(items, req, per_page=20)
    pages = sorted({(r.query_id, r.page_no) for r in kept.collect()})
    # q: batch (4,5) is empty -> pages 6, 7 cut; r: empty page 1 does not stop
    assert pages == [("q", 1), ("q", 2), ("q", 3), ("r", 2), ("r", 3)]
    budget = IN.page_budget(items, req.withColumn("num_results", F.lit(30)), per_page=20)
    assert max(r.page_no for r in budget.collect()) == 2
