"""The registered queries of this subpackage and their SQL twins."""

from flowlattice.llm import (
    alignment, decontamination, html, jaccard, language, mixing, packing, preference, quality, ranking, scoring, toxicity, warc)

QUERIES = {
    "op1_preference": preference.op1_preference,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_language": language.op5_language,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_html": html.op8_html,
    "op9_lm_scoring": scoring.op9_lm_scoring,
    "op10_warc": warc.op10_warc,
    "op11_mixing": mixing.op11_mixing,
    "op12_alignment": alignment.op12_alignment,
    "op13_ranked_search": ranking.op13_ranked_search,
}

ORACLES = {
    "op1_preference": preference.ORACLE_OP1,
    "op10_warc": warc.ORACLE_OP10,
    "op11_mixing": mixing.ORACLE_OP11,
    "op13_ranked_search": ranking.ORACLE_OP13,
}
