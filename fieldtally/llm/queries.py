"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import chat, infill, interaction, language, mixing, near_text, near_vectors, packed, personal, repetition, tokens, toxicity, warc


def queries() -> dict:
    return {
        "op1_byte_bpe": tokens.op1_byte_bpe,
        "op2_quantised_vectors": near_vectors.op2_quantised_vectors,
        "op3_warc_derivatives": warc.op3_warc_derivatives,
        "op4_repetition": repetition.op4_repetition,
        "op5_mixing": mixing.op5_mixing,
        "op6_minhash": near_text.op6_minhash,
        "op7_personal": personal.op7_personal,
        "op8_chat": chat.op8_chat,
        "op9_packed_tokens": packed.op9_packed_tokens,
        "op10_language": language.op10_language,
        "op11_fill_in_middle": infill.op11_fill_in_middle,
        "op12_filter_audit": interaction.op12_filter_audit,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def sql() -> dict[str, str]:
    return {
        "op3_warc_derivatives": warc.OP3_SQL,
        "op5_mixing": mixing.OP5_SQL,
        "op8_chat": chat.OP8_SQL,
        "op11_fill_in_middle": infill.OP11_SQL,
        "op12_filter_audit": interaction.OP12_SQL,
    }
