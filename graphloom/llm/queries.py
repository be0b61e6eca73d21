"""Named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from graphloom.llm import bpe, chat, codes, collocations, jaccard, langid, licenses, lm, mixing, neighbours, pieces, quality, secrets


def queries() -> dict[str, Callable]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_chat_format": chat.op2_chat_format,
        "op3_lattice_lm": lm.op3_lattice_lm,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_language_id": langid.op6_language_id,
        "op7_embedding_near_dedup": neighbours.op7_embedding_near_dedup,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_vector_codes": codes.op11_vector_codes,
        "op12_sentencepiece": pieces.op12_sentencepiece,
        "op13_phrase_collocations": collocations.op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.OP2_SQL,
        "op5_quality_rules": quality.OP5_SQL,
        "op7_embedding_near_dedup": neighbours.OP7_SQL,
        "op9_ngram_jaccard": jaccard.OP9_SQL,
        "op10_mix_sources": mixing.OP10_SQL,
        "op11_vector_codes": codes.OP11_SQL,
        "op13_phrase_collocations": collocations.OP13_SQL,
    }
