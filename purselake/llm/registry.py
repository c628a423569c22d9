"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from purselake.llm import exact_dedup, fill_in_middle, fingerprints, html_text, jaccard_join, license_scan, packing, pii, sentence_pieces, token_align, token_files, topk_search, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_pii": pii.op3_pii,
    "op4_sentencepiece": sentence_pieces.op4_sentencepiece,
    "op5_token_files": token_files.op5_token_files,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_ngram_jaccard_join": jaccard_join.op9_ngram_jaccard_join,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_cross_tokenizer_alignment": token_align.op12_cross_tokenizer_alignment,
    "op13_exact_topk": topk_search.op13_exact_topk,
}

#: The others have no SQL; tests/llm checks them by brute force or round trips.
ORACLE_SQL = {
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_fill_in_middle": fill_in_middle.OP11_SQL,
    "op13_exact_topk": topk_search.OP13_SQL,
}
