"""Extraction over page and PDF-page tables.

The per-row work is the Column functions of ``fanin.functions.html``; this
module holds the frame-level pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanin.functions import html as H
from fanin.functions.text import col_, pystrip


def truncate(text: Column | str, max_len: Column | int) -> Column:
    """Row 33: first ``max_len`` code points; ``max_len <= 0`` keeps the whole text."""
    t = col_(text)
    if isinstance(max_len, int):
        return t if max_len <= 0 else t.substr(F.lit(1), F.lit(max_len))
    return F.when(max_len <= 0, t).otherwise(t.substr(F.lit(1), max_len))


def content_length(text: Column | str, max_len: Column | int) -> Column:
    """``min(len(text), max_len)``, the true length when ``max_len <= 0``."""
    n = F.length(col_(text)).cast("bigint")
    if isinstance(max_len, int):
        return n if max_len <= 0 else F.least(n, F.lit(max_len).cast("bigint"))
    return F.when(max_len <= 0, n).otherwise(F.least(n, max_len.cast("bigint")))


def assemble_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Row 32: PDF page texts -> one text per document.

    Blank pages (Python-strip empty) drop out; the rest keep page order and
    are joined by a blank line.  The gathered list is one document's pages.
    """
    kept = pages.filter(pystrip(F.coalesce(F.col("text"), F.lit(""))) != "")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return kept.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"),
        F.count(F.lit(1)).alias("n_pages"))


def with_extraction(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows 26-28, 30: text, markdown, text-mode content and metadata next to each page."""
    return pages.select("*", H.extract_text(html).alias("text"), H.extract_markdown(html).alias("markdown"),
                        H.extract_content(html, "text").alias("plain"), H.page_metadata(html).alias("meta"))
