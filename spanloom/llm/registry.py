"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontam, htmltext, media, neardup, quality, suffixdedup, tokenfile, toxicity

QUERIES = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_token_file": tokenfile.op2_token_file,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_suffix_dedup": suffixdedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_html": htmltext.op7_html,
    "op8_media": media.op8_media,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op1_decontamination": decontam.OP1_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
}
