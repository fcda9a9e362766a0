"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from coursewright.llm import alignment, chat, decontam, exact_dedup, langid, line_dedup, lm, media, packing, secrets, simhash, toxicity, whitening

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_id": langid.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_media_columns": media.op6_media_columns,
    "op7_secrets": secrets.op7_secrets,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_alignment": alignment.op11_alignment,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
}
