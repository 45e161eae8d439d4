"""The queries of this subpackage and their DuckDB equivalents."""

from . import alignment, codes, decontamination, jaccard, main_text, packing, pii, quality, repeats, sharding, token_files, toxicity, url_filter

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op4_token_files": token_files.op4_token_files,
    "op2_repeated_passages": repeats.op2_repeated_passages,
    "op3_pii": pii.op3_pii,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_main_text": main_text.op12_main_text,
    "op13_vector_codes": codes.op13_vector_codes,
}

ORACLES = {
    "op7_sharding": sharding.OP7_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}
