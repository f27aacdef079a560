"""Main text vs. boilerplate from corpus statistics.

A page's text is split into blocks (lines); a block that appears on at least
``k`` distinct pages of the same host is boilerplate (navigation, ads,
footers) and is dropped; the rest is reassembled in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.functions.html import extract_text
from fanin.functions.text import pystrip
from fanin.functions.urls import with_result_domain
from fanin.session import ensure_checkpoint_dir


def blocks(pages: DataFrame, text: str = "text", block_hash=F.xxhash64) -> DataFrame:
    """``page_id, host, pos, block, h`` for the non-blank lines of each page."""
    b = pages.select("page_id", "host", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "block"))
    return b.filter(pystrip("block") != "").withColumn("h", block_hash("block"))


def boilerplate_blocks(b: DataFrame, k: int) -> DataFrame:
    """``host, block`` of the blocks on at least ``k`` distinct pages of their host.

    Pages are counted per hash first, with eight bytes a block; the texts themselves are counted only where a hash has
    enough pages, so that two texts of one hash are told apart."""
    often = b.select("host", "h", "page_id").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    texts = b.join(often.select("host", "h"), ["host", "h"], "left_semi").select("host", "h", "block", "page_id").distinct()
    return texts.groupBy("host", "h", "block").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("host", "h", "block")


def host_boilerplate(pages: DataFrame, k: int = 3, block_hash=F.xxhash64) -> DataFrame:
    """``page_id, host, main_text, n_blocks, n_kept`` for every page of ``(page_id, url, html)``."""
    p = with_result_domain(pages.select("page_id", "url", "html"), "url", "host").select(
        "page_id", "host", extract_text("html").alias("text"))
    # the blocks feed the per-host counts and the final join; the text is extracted once per page and written
    ensure_checkpoint_dir(p.sparkSession)
    p = p.checkpoint(eager=True)
    b = blocks(p, "text", block_hash)
    boiler = boilerplate_blocks(b, k).withColumn("_boiler", F.lit(True))
    flagged = b.join(boiler, ["host", "h", "block"], "left")
    kept_item = F.when(F.col("_boiler").isNull(), F.struct("pos", "block"))
    per_page = flagged.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count(kept_item).alias("n_kept"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept_item)), lambda x: x["block"]), "\n").alias("main_text"))
    return (p.select("page_id", "host").join(per_page, "page_id", "left")
            .select("page_id", "host", F.coalesce("main_text", F.lit("")).alias("main_text"),
                    F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"),
                    F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept")))
