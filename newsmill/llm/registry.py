"""Names of the corpus operators' queries and their SQL."""

from __future__ import annotations

from ..shared import one_table
from . import decontaminate, katz, line_crf, mixing, near_dedup, quality_model, secrets, site_tree, spelling, suffix_dedup, token_counts, vector_codes, warc


#: Queries that leave one table; the others leave those that their result is read from and what these were made of.
_TIDY = ("op1_suffix_dedup", "op5_decontamination", "op11_vector_codes", "op12_spelling_variants")


def _tidy(name: str, query):
    return (lambda spark, sf_dir: one_table(spark, name, lambda: query(spark, sf_dir))) if name in _TIDY else query


def queries() -> dict:
    return {name: _tidy(name, query) for name, query in _queries().items()}


def _queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_quality_model": quality_model.op2_quality_model,
        "op3_quality_rules": line_crf.op3_quality_rules,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_katz_scores": katz.op6_katz_scores,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_warc_normalise": warc.op8_warc_normalise,
        "op9_source_mix": mixing.op9_source_mix,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_main_text": site_tree.op13_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.OP1_SQL,
        "op7_near_dedup": near_dedup.OP7_SQL,
        "op8_warc_normalise": warc.OP8_SQL,
        "op9_source_mix": mixing.OP9_SQL,
        "op10_secret_scan": secrets.OP10_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
        "op13_main_text": site_tree.OP13_SQL,
    }
