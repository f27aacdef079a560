"""Scans: recorded result pages and page captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanin import schemas


def read_result_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Recorded result pages (one row per query, source and page) with a declared schema."""
    return spark.read.schema(schemas.RESULT_PAGES).format(fmt).load(path)


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Row 1: one row per item, page 1's items first, then page 2's, ...

    ``raw_pos`` (1-based, per query and source) is the item's position in
    the concatenated list.  It is computed on the page rows -- a running sum
    of earlier pages' sizes, at most ``MAX_PAGES`` rows per list -- and then
    the items are exploded with their in-page position, so no window ever
    runs over the items themselves.
    """
    w = (Window.partitionBy("query_id", "source").orderBy("page_no")
         .rowsBetween(Window.unboundedPreceding, -1))
    with_offset = pages.withColumn("_off", F.coalesce(F.sum(F.size(F.coalesce("items", F.array()))).over(w), F.lit(0)))
    exploded = with_offset.select("query_id", "source", "page_no", "_off",
                                  F.posexplode("items").alias("pos", "item"))
    return exploded.select("query_id", "source", "page_no", F.col("pos").cast("int").alias("pos"),
                           (F.col("_off") + F.col("pos") + 1).cast("bigint").alias("raw_pos"), "item.*")


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Row 2: page captures (text html and/or binary body) with a declared schema."""
    return spark.read.schema(schemas.CAPTURES).format(fmt).load(path)


def read_capture_files(spark: SparkSession, path: str, tier: str = "static") -> DataFrame:
    """Row 2, raw bodies: one capture per file via the binaryFile source (status 200 assumed)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("url"), F.lit(tier).alias("tier"), F.lit(200).alias("status"),
                      F.lit(None).cast("string").alias("content_type"),
                      F.when(~F.substring("content", 1, 4).eqNullSafe(F.lit(b"%PDF")),
                             F.decode("content", "UTF-8")).alias("html"),
                      F.col("content").alias("body"), F.lit(None).cast("string").alias("error"))


def conform_captures(df: DataFrame) -> DataFrame:
    """Bring any capture frame to the declared column set (missing columns as NULL)."""
    cols = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in cols else F.lit(None).cast(f.dataType)).alias(f.name)
                       for f in schemas.CAPTURES.fields])
