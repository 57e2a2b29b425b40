"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import bpe, chat, decontam, langid, media, ngram_join, pii, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_language_id": langid.op4_language_id,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_media_columns": media.op6_media_columns,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op7_ngram_jaccard_join": ngram_join.OP7_SQL,
    "op9_chat_formatting": chat.OP9_SQL,
}
