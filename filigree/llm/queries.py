"""Registered queries of the training-data operators, and the SQL that states their results."""

from __future__ import annotations

from . import conversation_repair, conversation_trie, exact_dedup, fingerprint, language, licenses, near_duplicates, packing, quality_classifier, quality_rules, sentencepiece_bpe, url_filter, wavelet

QUERIES = {
    "op1_language_id": language.query,
    "op2_fingerprints": fingerprint.query,
    "op3_near_duplicates": near_duplicates.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_quality_rules": quality_rules.query,
    "op6_token_wavelet": wavelet.query,
    "op7_license_scan": licenses.query,
    "op8_url_filter": url_filter.query,
    "op9_packing": packing.query,
    "op10_sentencepiece": sentencepiece_bpe.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_exact_dedup": exact_dedup.query,
    "op13_conversation_repair": conversation_repair.query,
}

ORACLE_SQL = {
    "op5_quality_rules": quality_rules.SQL,
    "op7_license_scan": licenses.SQL,
    "op8_url_filter": url_filter.SQL,
    "op12_exact_dedup": exact_dedup.SQL,
}
