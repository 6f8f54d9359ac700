"""The corpus queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, mixing, near_dedup, passages, pii, quality, token_files, url_filter

QUERIES = {
    "op1_pfair_mix": mixing.op1_pfair_mix,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_pii": pii.op5_pii,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality": quality.op8_quality,
    "op9_token_files": token_files.op9_token_files,
    "op10_passages": passages.op10_passages,
}

ORACLES = {
    "op6_embedding_dedup": embedding_dedup.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op10_passages": passages.ORACLE,
    "op1_pfair_mix": mixing.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
}
