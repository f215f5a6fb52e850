"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import (
    byte_bpe, chat_format, decontaminate, exact_dedup, fill_in_middle, jaccard_join, merkle_manifest, quality, sentence_pieces, subword_lm, toxicity, url_filter, wavelet_shards,
)

QUERIES = {
    "op1_wavelet_shards": wavelet_shards.op1_wavelet_shards,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality": quality.op3_quality,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_subword_lm": subword_lm.op6_subword_lm,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sentence_pieces": sentence_pieces.op8_sentence_pieces,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op10_jaccard_join_counts": jaccard_join.op10_jaccard_join_counts,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}

SQL = {
    "op2_decontaminate": decontaminate.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_chat_format": chat_format.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op10_jaccard_join_counts": jaccard_join.SQL_COUNTS,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
