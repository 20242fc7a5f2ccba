"""The dealt operators' queries and SQL, by name."""

from __future__ import annotations

from lodestone.llm import exact_dedup, fim, langid, licenses, near_dedup, packing, phrases, quality, secrets, token_counts, tokens, topk, url_filter

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_top_k": topk.op2_top_k,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_byte_bpe": tokens.op7_byte_bpe,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_quality": quality.op9_quality,
    "op10_language_id": langid.op10_language_id,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_phrases": phrases.op12_phrases,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
SQL = {
    "op2_top_k": topk.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_url_filter": url_filter.SQL,
    "op12_phrases": phrases.SQL,
    "op13_fill_in_middle": fim.SQL,
}
