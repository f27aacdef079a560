"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from fanin.llm.descent import OP11_SQL, op11_embedding_near_dedup
from fanin.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from fanin.llm.htmltext import op3_html_extraction
from fanin.llm.langid import op8_language_id
from fanin.llm.manifest import OP12_SQL, op12_merkle_manifest
from fanin.llm.mixing import OP6_SQL, op6_mix_sources
from fanin.llm.packing import op10_packing
from fanin.llm.quality import op9_quality_rules
from fanin.llm.repair import OP13_SQL, op13_conversation_repair
from fanin.llm.simhash import op5_simhash_near_dedup
from fanin.llm.substrings import op1_suffix_dedup
from fanin.llm.trainorder import op4_training_order
from fanin.llm.urlrules import op2_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_html_extraction": op3_html_extraction,
    "op4_training_order": op4_training_order,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_mix_sources": op6_mix_sources,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op6_mix_sources": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op11_embedding_near_dedup": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
           "op13_conversation_repair": OP13_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
