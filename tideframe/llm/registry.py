"""The queries of this subpackage and the SQL that states their results, where SQL can."""

from tideframe.llm import decontaminate, language, mixing, neardup, pages, quality, substrings, suffix_tree, tokens, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op10_suffix_tree_score": suffix_tree.query,
    "op2_near_duplicates": neardup.query,
    "op3_quality_rules": quality.query,
    "op4_language_id": language.query,
    "op5_source_mixing": mixing.query,
    "op6_repeated_substrings": substrings.query,
    "op7_decontamination": decontaminate.query,
    "op8_token_counts": tokens.query,
    "op9_main_text": pages.query,
}

ORACLES = {
    "op3_quality_rules": quality.oracle_sql,
    "op5_source_mixing": mixing.oracle_sql,
}
