"""The thin queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from docketry.llm import bpe, chat_format, decontaminate, html_extract, jaccard_join, lexical, license_scan, line_dedup, projection_forest, quality, suffix_tree_lm, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_benchmark_decontamination": decontaminate.query,
    "op3_bpe_codec": bpe.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_line_dedup": line_dedup.query,
    "op6_quality_rules": quality.query,
    "op7_lm_scoring": suffix_tree_lm.query,
    "op8_license_scan": license_scan.query,
    "op9_chat_format": chat_format.query,
    "op10_html_extraction": html_extract.query,
    "op11_lexical_search": lexical.query,
    "op12_embedding_whitening": whitening.query,
    "op13_projection_forest": projection_forest.query,
}

ORACLES: dict[str, str] = {"op1_url_filter": url_filter.oracle_sql(), "op6_quality_rules": quality.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL}
