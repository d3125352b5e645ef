"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quaver.llm import conversation_trie, decontamination, html_extraction, lines, ngram_join, packing, quality, sharding, substrings, tokenfile, urls, vector_codes, warc

QUERIES = {
    "op1_html_extraction": html_extraction.query,
    "op2_benchmark_decontamination": decontamination.query,
    "op3_url_filters": urls.query,
    "op4_sharding": sharding.query,
    "op5_ngram_jaccard_join": ngram_join.query,
    "op6_best_fit_packing": packing.query,
    "op7_line_dedup": lines.query,
    "op8_token_id_output": tokenfile.query,
    "op9_substring_dedup": substrings.query,
    "op10_quality_rules": quality.query,
    "op11_conversation_prefix_trie": conversation_trie.query,
    "op12_warc": warc.query,
    "op13_vector_code_compression": vector_codes.query,
}

SQL = {
    "op2_benchmark_decontamination": decontamination.SQL,
    "op3_url_filters": urls.SQL,
    "op4_sharding": sharding.SQL,
    "op7_line_dedup": lines.SQL,
    "op11_conversation_prefix_trie": conversation_trie.SQL,
    "op12_warc": warc.SQL,
    "op13_vector_code_compression": vector_codes.SQL,
}
