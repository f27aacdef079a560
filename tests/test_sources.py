import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from fanin.operators import capture as CA
from fanin.plans.q_search import Ctx, pages_a
from fanin.plans import catalog
from fanin.sources import tables as TB
from fanin.sources.sinks import read_report_json, write_report_json, write_report_rows

SF = "/root/testdata/sf0.001"


def test_result_pages_json_round_trip_and_flatten(spark):
    pages = pages_a(Ctx(spark, SF))
    path = os.path.join(tempfile.mkdtemp(prefix="fanin-pages-"), "p")
    pages.write.json(path)
    back = TB.read_result_pages(spark, path, "json")
    a = TB.flatten_pages(back).select("query_id", "raw_pos", "url")
    b = TB.flatten_pages(pages).select("query_id", "raw_pos", "url")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # raw positions are 1..n per list, in page order
    per = a.groupBy("query_id").agg(F.min("raw_pos").alias("lo"), F.max("raw_pos").alias("hi"), F.count("*").alias("n"))
    assert all(r.lo == 1 and r.hi == r.n for r in per.collect())


def test_binary_capture_files_route_by_magic_bytes(spark):
    d = tempfile.mkdtemp(prefix="fanin-bin-")
    with open(os.path.join(d, "a.html"), "wb") as f:
        f.write("<html><head><title>T é</title></head><body><p>hello</p></body></html>".encode())
    with open(os.path.join(d, "paper"), "wb") as f:
        f.write(b"%PDF-1.7 binary")
    caps = TB.read_capture_files(spark, d)
    routes = {os.path.basename(r.url): r.route for r in CA.route(caps).collect()}
    assert routes == {"a.html": "html", "paper": "pdf_sniffed"}
    resolved = {os.path.basename(r.url): r for r in CA.resolve(caps).collect()}
    assert resolved["a.html"].title == "T é" and resolved["paper"].error == CA.NO_PDF_TEXT


def test_report_json_keeps_non_ascii(spark):
    df = spark.createDataFrame([("q", "é ü 中", "2024-01-10")], "query_id string, title string, run_date string")
    path = os.path.join(tempfile.mkdtemp(prefix="fanin-rep-"), "r")
    write_report_json(df, path, ("run_date",))
    raw = "".join(open(os.path.join(root, f), encoding="utf-8").read()
                  for root, _, files in os.walk(path) for f in files if f.endswith(".json"))
    assert "é ü 中" in raw
    assert read_report_json(spark, path, df.schema).first().title == "é ü 中"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and {"query_id", "rank", "url", "status", "cached", "content_length"} <= set(df.columns)
    own = set(catalog.queries())
    assert own <= set(E.queries()) and own == set(catalog.oracle_sql()) <= set(E.oracle_sql())


def test_flat_report_rows_parquet(spark):
    from fanin.plans.q_report import rows
    r = rows(Ctx(spark, SF)).withColumn("run_date", F.lit("2024-01-10"))
    path = os.path.join(tempfile.mkdtemp(prefix="fanin-flat-"), "r")
    write_report_rows(r, path, ("run_date",))
    back = spark.read.parquet(path)
    cols = [c for c in r.columns if c != "run_date"]
    assert back.select(*cols).exceptAll(r.select(*cols)).count() == 0 and back.count() == r.count()
