"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (decontaminate, host_rules, katz, language_id, line_dedup, main_text, mixing, ngram_join, prefix_trie,
               quality, url_filter, vector_codes, warc)


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_warc": warc.op3_warc,
        "op4_main_text": main_text.op4_main_text,
        "op5_language_id": language_id.op5_language_id,
        "op6_quality": quality.op6_quality,
        "op7_katz": katz.op7_katz,
        "op8_host_rules": host_rules.op8_host_rules,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_mixing": mixing.op10_mixing,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.SQL,
        "op8_host_rules": host_rules.SQL,
        "op9_decontamination": decontaminate.SQL,
        "op10_mixing": mixing.SQL,
        "op11_prefix_trie": prefix_trie.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_line_dedup": line_dedup.SQL,
    }
