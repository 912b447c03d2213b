"""The queries of the thirteen operators over the given tables."""

from __future__ import annotations

from palmleaf.llm import capfilters, chat, htmltext, langid, licenses, mixing, neighbours, packing, repair, sharding, simhash, substring, whitening
from palmleaf.shared import table

QUERIES = {
    "op1_simhash_dedup": lambda spark, sf: simhash.simhash_report(table(spark, sf, "documents")),
    "op2_language": lambda spark, sf: langid.language_report(table(spark, sf, "documents")),
    "op3_neighbours": lambda spark, sf: neighbours.neighbours_report(table(spark, sf, "embeddings")),
    "op4_substring_dedup": lambda spark, sf: substring.substring_report(table(spark, sf, "documents")),
    "op5_packing": lambda spark, sf: packing.packing_report(table(spark, sf, "documents")),
    "op6_mixing": lambda spark, sf: mixing.mixture_report(table(spark, sf, "documents")),
    "op7_chat": lambda spark, sf: chat.chat_report(table(spark, sf, "conversations")),
    "op8_embedding_dedup": lambda spark, sf: capfilters.near_duplicates(table(spark, sf, "embeddings")),
    "op9_html_text": lambda spark, sf: htmltext.extraction_report(table(spark, sf, "pages")),
    "op10_sharding": lambda spark, sf: sharding.shard_report(table(spark, sf, "documents")),
    "op11_conversation_repair": lambda spark, sf: repair.repair_report(table(spark, sf, "conversations")),
    "op12_whitening": lambda spark, sf: whitening.whitening_report(table(spark, sf, "embeddings")),
    "op13_licenses": lambda spark, sf: licenses.license_report(table(spark, sf, "documents")),
}
ORACLE = {"op6_mixing": mixing.mixture_sql(), "op11_conversation_repair": repair.repair_sql(), "op13_licenses": licenses.license_sql()}
