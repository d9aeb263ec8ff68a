"""Registered queries of the training-data operators, and SQL where it can say them."""

from spanforge.llm import op1_decontaminate, op2_pii, op3_license, op4_toxicity, op5_jaccard, op6_langid, op7_lm, op8_packing, op9_quality, op10_rules

QUERIES = {
    "op1_decontaminate": op1_decontaminate.query,
    "op2_pii_surrogates": op2_pii.query,
    "op3_license_scan": op3_license.query,
    "op4_toxicity_chain": op4_toxicity.query,
    "op5_jaccard_parity": op5_jaccard.query,
    "op6_language_id": op6_langid.query,
    "op7_masked_lm": op7_lm.query,
    "op8_packing": op8_packing.query,
    "op9_quality": op9_quality.query,
    "op10_adaptive_rules": op10_rules.query,
}

ORACLES = {
    "op1_decontaminate": op1_decontaminate.ORACLE,
    "op5_jaccard_parity": op5_jaccard.ORACLE,
    "op10_adaptive_rules": op10_rules.ORACLE,
}
