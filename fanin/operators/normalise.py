"""Per-source normalisation to one result shape.

Shared shape: ``query_id, source, raw_rank INT (0-based), href, title, body,
engines ARRAY<STRING>, score DOUBLE, published_us BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanin.functions.text import pystrip, pystrip_null_safe
from fanin.params import MAX_NUM_RESULTS, SOURCE_B_ENGINES

RESULT_COLUMNS = ("query_id", "source", "raw_rank", "href", "title", "body", "engines", "score", "published_us")


def _rank_and_cap(df: DataFrame, order: str, requests: DataFrame, cap: Column | None = None,
                  most: int = MAX_NUM_RESULTS) -> DataFrame:
    """0-based rank per query by ``order``; keep the first n (n per query).

    ``most`` is the caller's bound on n (intake clamps to it).  That constant cut
    comes first, so Catalyst plans a ``WindowGroupLimit``: a query with a huge raw
    list sends at most ``most`` rows per map partition, and the join with the
    requests for each query's own n sees at most that many rows.
    """
    n = F.col("num_results") if cap is None else cap
    w = Window.partitionBy("query_id").orderBy(order)
    top = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    return (top.join(requests.select("query_id", "num_results"), "query_id")
            .filter(F.col("_rn") <= n)
            .withColumn("raw_rank", (F.col("_rn") - 1).cast("int"))
            .drop("_rn", "num_results"))


def normalise_a(items: DataFrame, requests: DataFrame, source: str = "a", most: int = MAX_NUM_RESULTS) -> DataFrame:
    """Row 9: source A items (``query_id, raw_pos, url, title, content[, engines][, score]``).

    Strip the url, drop blanks, keep the first row per exact stripped url,
    strip title/content (NULL-safe), engines default [], score default 0, then
    the first ``num_results`` by position.
    """
    cols = set(items.columns)
    engines = F.coalesce(F.col("engines"), F.array().cast("array<string>")) if "engines" in cols \
        else F.array().cast("array<string>")
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in cols else F.lit(0.0)
    pub = F.col("published_us") if "published_us" in cols else F.lit(None).cast("bigint")
    df = (items.select("query_id", "raw_pos", pystrip_null_safe("url").alias("href"),
                       pystrip_null_safe("title").alias("title"), pystrip_null_safe("content").alias("body"),
                       engines.alias("engines"), score.alias("score"), pub.alias("published_us"))
          .filter(F.col("href") != ""))
    first = Window.partitionBy("query_id", "href").orderBy("raw_pos")
    df = df.withColumn("_d", F.row_number().over(first)).filter(F.col("_d") == 1).drop("_d")
    return (_rank_and_cap(df, "raw_pos", requests, most=most)
            .withColumn("source", F.lit(source)).select(*RESULT_COLUMNS))


def normalise_b(items: DataFrame, requests: DataFrame, source: str = "b", most: int = MAX_NUM_RESULTS,
                source_max: int | None = None) -> DataFrame:
    """Row 10: source B items (``query_id, pos, href, url, title, body[, published_us]``).

    href, else url, stripped; blanks dropped; no dedupe; engines fixed; score
    1.0; the first ``num_results``, or ``min(source_max, num_results)`` if the
    caller sets a bound (``SOURCE_B_MAX`` is what one download holds).
    """
    cols = set(items.columns)
    href = pystrip(F.coalesce(F.nullif(F.col("href"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.lit("")))
    pub = F.col("published_us") if "published_us" in cols else F.lit(None).cast("bigint")
    df = (items.select("query_id", "pos", href.alias("href"), pystrip_null_safe("title").alias("title"),
                       pystrip_null_safe("body").alias("body"),
                       F.array(*[F.lit(e) for e in SOURCE_B_ENGINES]).alias("engines"), F.lit(1.0).alias("score"),
                       pub.alias("published_us"))
          .filter(F.col("href") != ""))
    n = F.col("num_results")
    return (_rank_and_cap(df, "pos", requests, n if source_max is None else F.least(n, F.lit(source_max)), most)
            .withColumn("source", F.lit(source)).select(*RESULT_COLUMNS))


def union_sources(*frames: DataFrame) -> DataFrame:
    """Row 11: all sources in one shape."""
    out = frames[0].select(*RESULT_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*RESULT_COLUMNS))
    return out
