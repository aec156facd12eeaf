"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from marginalia.llm import ann, byte_bpe, chat, hpylm, jaccard, media, mixing, packing, pii, quality, resampling, substring, vector_codes

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_media_columns": media.op3_media_columns,
    "op4_mixing": mixing.op4_mixing,
    "op5_pii": pii.op5_pii,
    "op6_nearest_neighbours": ann.op6_nearest_neighbours,
    "op7_lm_scoring": hpylm.op7_lm_scoring,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_packing": packing.op9_packing,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_resampling": resampling.op12_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op1_chat_formatting": chat.SQL,
    "op12_resampling": resampling.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
