"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import langid, licences, lm, mixing, near_dups, packing, quality, search, substrings, toxicity

QUERIES = {
    "op1_topk": search.op1_topk,
    "op2_quality": quality.op2_quality,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_language": langid.op5_language,
    "op6_substrings": substrings.op6_substrings,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_licences": licences.op8_licences,
    "op9_near_duplicates": near_dups.op9_near_duplicates,
    "op10_lm": lm.op10_lm,
    # what SQL can express of three of them
    "quality_base": quality.quality_base,
    "licence_base": licences.licence_base,
    "lm_base": lm.lm_base,
}

ORACLES = {
    "op1_topk": search.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "op9_near_duplicates": near_dups.OP9_SQL,
    "quality_base": quality.QUALITY_BASE_SQL,
    "licence_base": licences.LICENCE_BASE_SQL,
    "lm_base": lm.LM_BASE_SQL,
}
