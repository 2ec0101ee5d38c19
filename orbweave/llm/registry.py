"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from orbweave.llm import bpe, cover_tree, decontamination, near_dedup, pii, quality, repeats, search, sharding, spelling, text_rules, toxicity, warc


def queries() -> dict:
    found = [
        sharding.op1_hypergeometric_sharding,
        quality.op2_quadratic_discriminant_quality,
        cover_tree.op3_cover_tree_embedding_dedup,
        toxicity.op4_noisy_channel_toxicity,
        bpe.op5_byte_level_bpe,
        warc.op6_zip_packaged_warc,
        repeats.op7_suffix_array_dedup,
        decontamination.op8_winnowing_decontamination,
        pii.op9_weakly_supervised_pii,
        near_dedup.op10_odd_sketch_near_dedup,
        text_rules.op11_quality_rules,
        spelling.op12_spelling_variant_grouping,
        search.op13_ranked_lexical_search,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_cover_tree_embedding_dedup": cover_tree.OP3_SQL,
        "op6_zip_packaged_warc": warc.OP6_SQL,
        "op8_winnowing_decontamination": decontamination.OP8_SQL,
        "op10_odd_sketch_near_dedup": near_dedup.OP10_SQL,
        "op11_quality_rules": text_rules.OP11_SQL,
        "op12_spelling_variant_grouping": spelling.OP12_SQL,
        "op13_ranked_lexical_search": search.OP13_SQL,
    }
