"""The corpus pipeline: STAGES run one after another over ``documents``, each over all its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``docs`` must be a stable scan, such as the Parquet files that ``run`` writes between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fanin.llm.common import documents, materialise
from fanin.llm.exact_dedup import drop_copies
from fanin.llm.mixing import mix
from fanin.llm.packing import packed_digest
from fanin.llm.quality import keep_good
from fanin.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that fail the base rules or whose lines are mostly boilerplate go.  The field is fitted on a
    bounded sample of the labelled rows among ``docs``."""
    return keep_good(docs, documents(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the row with the smallest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of documents linked by fingerprints within 3 bits the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: whole and cut copies of documents, so that the sources' words meet their targets."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of sequences of at most 2048 ids."""
    return packed_digest(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup),
          ("mixing sources", mix_sources), ("packing", packing)]

#: The fitted field and the tokeniser have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage{i}")
    return docs
