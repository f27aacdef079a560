"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from fanin.plans import q_capture, q_corpus, q_health, q_memo, q_report, q_search, q_stream  # noqa: F401
from fanin.plans.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """The research call: fused top-N per query, memo split, misses resolved, report rows (13-16, 35, 22, 46)."""
    return QUERIES["research_report"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
