"""The queries of this subpackage by name, and SQL for those that it can express."""

from __future__ import annotations

from graphweft.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from graphweft.llm.fuzzy_passages import op5_fuzzy_passages
from graphweft.llm.language_id import op1_language_id
from graphweft.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from graphweft.llm.ngram_join import op4_ngram_join
from graphweft.llm.personal_data import op11_personal_data
from graphweft.llm.quality_classifier import op9_quality_classifier
from graphweft.llm.quality_rules import op6_quality_rules
from graphweft.llm.ranked_search import OP13_SQL, op13_ranked_search
from graphweft.llm.secret_scan import op10_secret_scan
from graphweft.llm.sentencepiece_codec import op7_sentencepiece
from graphweft.llm.source_mix import op3_source_mix
from graphweft.llm.suffix_dedup import op8_suffix_dedup

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_ngram_join": op4_ngram_join,
    "op5_fuzzy_passages": op5_fuzzy_passages,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_secret_scan": op10_secret_scan,
    "op11_personal_data": op11_personal_data,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
