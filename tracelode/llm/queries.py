"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import bpe, collocations, decontaminate, language, near_dups, prefix_trie, quality_model, quality_rules, simhash, suffixes, token_counts, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_urls": urls.op3_urls,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality": quality_model.op5_quality,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language": language.op10_language,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_near_dups": near_dups.op8_near_dups,
    "op11_collocations": collocations.op11_collocations,
    "op12_simhash": simhash.op12_simhash,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
CHECKS: dict[str, str] = {
    "op3_urls": urls.OP3_SQL, "op8_near_dups": near_dups.OP8_SQL, "op11_collocations": collocations.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
