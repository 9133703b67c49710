"""The queries of this subpackage, and the SQL that yields the same rows where SQL can."""

from __future__ import annotations

from . import bpe, chat, fingerprints, jaccard, language, media, mixing, pii, substrings, toxicity

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_personal_data": pii.op5_personal_data,
    "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
    "op7_transport_streams": media.op7_transport_streams,
    "op8_chat_windows": chat.op8_chat_windows,
    "op9_bpe": bpe.op9_bpe,
    "op10_language": language.op10_language,
}
ORACLES = {**mixing.ORACLE, **chat.ORACLE}
