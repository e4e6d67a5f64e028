"""The queries of this subpackage and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from hubwright.llm import (
    ann, bpe, chat_format, exact_dedup, lexical_search, line_dedup, packing, quality, secret_scan, sharding, simhash, url_filter, variants,
)

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_ann_posting_lists": ann.op2_ann_posting_lists,
    "op3_bpe_round_trip": bpe.op3_bpe_round_trip,
    "op4_pack_best_fit": packing.op4_pack_best_fit,
    "op5_simhash_components": simhash.op5_simhash_components,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_external_shuffle": sharding.op9_external_shuffle,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_line_dedup": line_dedup.op13_line_dedup,
}

TWINS: dict[str, str] = {
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op13_line_dedup": line_dedup.OP13_SQL,
}
