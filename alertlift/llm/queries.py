"""Registered queries of this package: one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertlift.llm import chat_format, filter_audit, merkle
from alertlift.llm.bpe_trie import op7_bpe_trie
from alertlift.llm.chat_format import op11_chat_format
from alertlift.llm.filter_audit import op13_filter_audit
from alertlift.llm.language import op1_language_id
from alertlift.llm.lattice import op4_embedding_near_dedup
from alertlift.llm.merkle import op12_merkle_manifest
from alertlift.llm.mixing import op6_mixing
from alertlift.llm.ngram_join import op3_ngram_jaccard_join
from alertlift.llm.quality_rules import op9_quality_rules
from alertlift.llm.quality_zstd import op5_quality_classifier
from alertlift.llm.secrets import op8_secret_scan
from alertlift.llm.token_store import op2_token_store
from alertlift.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_token_store, op3_ngram_jaccard_join, op4_embedding_near_dedup, op5_quality_classifier,
        op6_mixing, op7_bpe_trie, op8_secret_scan, op9_quality_rules, op10_toxicity,
        op11_chat_format, op12_merkle_manifest, op13_filter_audit,
    )
}

#: Of the others, results are trained, random, iterative or bound to a library, and shingle joins are too slow in SQL on
#: whole tables; their tests compare with brute force.
ORACLES: dict[str, str] = {
    "op11_chat_format": chat_format.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
