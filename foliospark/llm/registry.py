"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontamination, html_text, language, lm_scoring, merkle, mpeg_audio, near_duplicates, packing, quality, spelling, substrings, token_files, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_compression_language_id": language.op1_compression_language_id,
        "op2_template_decontamination": decontamination.op2_template_decontamination,
        "op3_sentence_span_dedup": substrings.op3_sentence_span_dedup,
        "op4_fourier_quality": quality.op4_fourier_quality,
        "op5_mpeg_audio": mpeg_audio.op5_mpeg_audio,
        "op6_masked_pseudo_likelihood": lm_scoring.op6_masked_pseudo_likelihood,
        "op7_separator_token_counts": token_files.op7_separator_token_counts,
        "op8_nnls_packing": packing.op8_nnls_packing,
        "op9_minhash_near_duplicates": near_duplicates.op9_minhash_near_duplicates,
        "op10_url_ngram_filter": urls.op10_url_ngram_filter,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_html_block_rules": html_text.op12_html_block_rules,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle_manifest": merkle.oracle(), "op13_spelling_variants": spelling.oracle()}
