"""Request intake and page-level pruning."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanin.functions.text import pystrip
from fanin.params import (DEFAULT_MAX_CONTENT_LENGTH, DEFAULT_NUM_RESULTS, DEFAULT_SEARCH_NUM_RESULTS,
                          MAX_CONTENT_LENGTH, MAX_NUM_RESULTS, MAX_PAGES, MIN_CONTENT_LENGTH, QUERY_ERROR,
                          RESULTS_PER_PAGE, TIME_RANGE_ERROR, VALID_TIME_RANGES)

# A JSON number token (no NaN / Infinity).
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def validate(requests: DataFrame) -> DataFrame:
    """Row 5: strip the query, normalise time_range, give a reject reason (NULL when accepted)."""
    q = pystrip(F.coalesce(F.col("query"), F.lit("")))
    tr = F.lower(pystrip(F.coalesce(F.col("time_range"), F.lit(""))))
    reason = (F.when(q == "", F.lit(QUERY_ERROR))
              .when(~tr.isin(*VALID_TIME_RANGES), F.lit(TIME_RANGE_ERROR)))
    return (requests.withColumn("query", q).withColumn("time_range", tr)
            .withColumn("reject_reason", reason)
            .withColumn("accepted", F.col("reject_reason").isNull()))


def clamp_number(text: Column, lo: int, hi: int, invalid: int, absent: int) -> Column:
    """Parse a numeric token, truncate toward zero, clamp to [lo, hi].

    NULL -> ``absent``; anything that is not a number -> ``invalid``.
    Clamping before truncation gives the same value because the bounds are
    whole numbers, and keeps huge inputs away from integer overflow.
    """
    s = pystrip(text)
    v = F.least(F.greatest(s.try_cast("double"), F.lit(float(lo))), F.lit(float(hi)))
    parsed = F.floor(v).cast("int")
    return (F.when(text.isNull(), F.lit(absent))
            .when(s.rlike(NUMBER_RE), parsed)
            .otherwise(F.lit(invalid)))


def clamp(requests: DataFrame, call: str = "research") -> DataFrame:
    """Row 6: num_results -> 1..200, max_content_length -> 500..500000.

    ``call='search'`` uses 20 for an absent num_results, ``'research'`` 15;
    unparsable values always fall back to 15 / 20000.
    """
    absent_n = DEFAULT_SEARCH_NUM_RESULTS if call == "search" else DEFAULT_NUM_RESULTS
    return (requests
            .withColumn("num_results", clamp_number(F.col("num_results"), 1, MAX_NUM_RESULTS,
                                                    DEFAULT_NUM_RESULTS, absent_n))
            .withColumn("max_content_length", clamp_number(F.col("max_content_length"), MIN_CONTENT_LENGTH,
                                                           MAX_CONTENT_LENGTH, DEFAULT_MAX_CONTENT_LENGTH,
                                                           DEFAULT_MAX_CONTENT_LENGTH)))


def page_budget_col(num_results: Column, per_page: int = RESULTS_PER_PAGE, max_pages: int = MAX_PAGES) -> Column:
    return F.least(F.greatest(F.ceil(num_results / F.lit(per_page)), F.lit(1)), F.lit(max_pages)).cast("int")


def page_budget(items: DataFrame, requests: DataFrame, per_page: int = RESULTS_PER_PAGE,
                max_pages: int = MAX_PAGES) -> DataFrame:
    """Row 7: keep pages 1..clamp(ceil(n / per_page), 1, max_pages) of each query."""
    budget = requests.select("query_id", page_budget_col(F.col("num_results"), per_page, max_pages).alias("_pages"))
    return (items.join(budget, "query_id")
            .filter(F.col("page_no") <= F.col("_pages")).drop("_pages"))


def page_early_stop(items: DataFrame, requests: DataFrame, per_page: int = RESULTS_PER_PAGE,
                    max_pages: int = MAX_PAGES) -> DataFrame:
    """Row 8: page 1, then batches (2,3), (4,5), ...; the first empty batch ends paging.

    Works on a per-page count (map-side partial aggregate, at most
    ``max_pages`` rows per query) rather than on the items, then filters the
    items by the per-query stop batch.  An absent page counts as empty.
    """
    budget = requests.select("query_id", page_budget_col(F.col("num_results"), per_page, max_pages).alias("_pages"))
    counts = items.groupBy("query_id", "page_no").agg(F.count(F.lit(1)).alias("_n"))
    all_pages = budget.select("query_id", F.explode(F.sequence(F.lit(1), F.col("_pages"))).alias("page_no"))
    per_batch = (all_pages.join(counts, ["query_id", "page_no"], "left")
                 .withColumn("_batch", F.floor(F.col("page_no") / 2))
                 .groupBy("query_id", "_batch").agg(F.sum(F.coalesce(F.col("_n"), F.lit(0))).alias("_n")))
    stop = (per_batch.filter((F.col("_batch") >= 1) & (F.col("_n") == 0))
            .groupBy("query_id").agg(F.min("_batch").alias("_stop")))
    return (items.join(budget, "query_id").join(stop, "query_id", "left")
            .filter((F.col("page_no") <= F.col("_pages"))
                    & (F.floor(F.col("page_no") / 2) <= F.coalesce(F.col("_stop"), F.lit(max_pages))))
            .drop("_pages", "_stop"))


def months_back(as_of_us: int, months: int) -> int:
    """``as_of - INTERVAL n MONTH`` in UTC, day clamped to the month's end (SQL semantics)."""
    t = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=as_of_us)
    y, m = divmod(t.year * 12 + (t.month - 1) - months, 12)
    d = min(t.day, calendar.monthrange(y, m + 1)[1])
    back = t.replace(year=y, month=m + 1, day=d)
    return (back - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def time_range_cutoffs(as_of_us: int) -> dict[str, int]:
    day = 86_400_000_000
    return {"d": as_of_us - day, "w": as_of_us - 7 * day,
            "m": months_back(as_of_us, 1), "y": months_back(as_of_us, 12)}


def time_range_filter(results: DataFrame, requests: DataFrame | None, as_of_us: int,
                      published: str = "published_us", time_range: str | None = None) -> DataFrame:
    """Row 12: keep results published within the query's range before ``as_of``.

    '' keeps everything (undated too); a set range drops undated rows.  With
    one ``time_range`` for the whole call the test is a comparison with a
    constant, which Parquet predicate pushdown takes to the scan; with
    per-query ranges (``requests.time_range``) it follows a join on query_id.
    """
    cut = time_range_cutoffs(as_of_us)
    if time_range is not None:
        return results if time_range == "" else results.filter(F.col(published) >= F.lit(cut[time_range]))
    pub = F.col(published)
    tr = F.col("_tr")
    keep = F.when(tr == "", F.lit(True))
    for k, c in cut.items():
        keep = keep.when(tr == k, pub >= F.lit(c))
    keep = F.coalesce(keep.otherwise(F.lit(False)), F.lit(False))
    ranges = requests.select("query_id", F.coalesce(F.col("time_range"), F.lit("")).alias("_tr"))
    return results.join(ranges, "query_id").filter(keep).drop("_tr")
