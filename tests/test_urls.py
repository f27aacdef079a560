import random

import pytest
from pyspark.sql import functions as F

from fanin.functions import urls as U
from fanin.params import TRACKING_KEYS
from pyref import URL_TABLE


def _frame(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, u string")


def test_written_cases(spark):
    rows = _frame(spark, [x[0] for x in URL_TABLE]).orderBy("id").select(
        "u", U.canonical_url("u").alias("c"), U.result_domain("u").alias("d"), U.pdf_title("u").alias("t")).collect()
    assert [(r.u, r.c, r.d, r.t) for r in rows] == URL_TABLE


def test_random_urls_keep_the_rules(spark):
    rng = random.Random(7)
    alphabet = list("aB:/?#&=.%[]@ \tx1_-") + ["utm_source", "ref", "http", "https", "www.", "//", " ", "é"]
    urls = [x[0] for x in URL_TABLE] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = _frame(spark, urls)
    staged = U.with_result_domain(U.with_canonical_url(df, "u", "cs"), "u", "ds")
    out = staged.select("u", "cs", "ds", U.canonical_url("u").alias("c"), U.result_domain("u").alias("d")).collect()
    again = {r.u: r.c for r in _frame(spark, [r.c for r in out]).select("u", U.canonical_url("u").alias("c")).distinct().collect()}
    for r in out:
        assert r.c == r.cs and r.d == r.ds, repr(r.u)
        readable = r.c != r.u.strip().lower() or "[" not in r.u
        if readable:
            assert "#" not in r.c and "www." not in r.d, repr(r.u)
            keys = [p.split("=", 1)[0].lower() for p in r.c.split("?", 1)[1].split("&")] if "?" in r.c else []
            assert not set(keys) & set(TRACKING_KEYS), repr(r.u)
            assert r.c.split("?", 1)[0].endswith("/") <= (r.c.split("?", 1)[0].rstrip("/").count("/") <= 2), repr(r.u)
        if r.c == r.c.strip() and r.c.startswith(("http://", "https://")) and not r.c.split("//", 1)[1].startswith("/"):
            assert again[r.c] == r.c, repr(r.u)


@pytest.mark.parametrize("url,expected", [("https://x.com/a.pdf", True), ("https://x.com/A.PDF", True),
                                          ("https://x.com/a;.pdf/b", True), ("https://x.com/a.pdf?x=1", True),
                                          ("https://x.com/a.pdfx", False), ("https://x.com/?f=a.pdf", False)])
def test_pdf_by_url(spark, url, expected):
    assert spark.range(1).select(U.looks_like_pdf_url(F.lit(url)).alias("p")).first().p is expected
