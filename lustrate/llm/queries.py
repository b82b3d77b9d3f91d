"""The queries of this subpackage and, where SQL can express them, their oracles."""

from lustrate.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup, packing, quality, sharding, spelling, suffix_dedup, token_alignment, url_filter, warc

QUERIES = {
    "op1_hypergeometric_shards": sharding.op1_hypergeometric_shards,
    "op2_suffix_repeats": suffix_dedup.op2_suffix_repeats,
    "op3_hierarchical_quality": quality.op3_hierarchical_quality,
    "op4_latent_decontamination": decontaminate.op4_latent_decontamination,
    "op5_warc_revisits": warc.op5_warc_revisits,
    "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
    "op7_url_rules": url_filter.op7_url_rules,
    "op8_language_id": language_id.op8_language_id,
    "op9_bottomk_near_dedup": near_dedup.op9_bottomk_near_dedup,
    "op10_radix_dedup": exact_dedup.op10_radix_dedup,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op5_warc_revisits": warc.OP5_SQL,
    "op7_url_rules": url_filter.OP7_SQL,
    "op10_radix_dedup": exact_dedup.OP10_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
}
