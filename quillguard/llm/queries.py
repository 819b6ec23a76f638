"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import bpe, chat, classifier, embeddings, mixing, neardup, quality, sharding, substring, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_rules,
        neardup.op2_minhash_near_dedup,
        substring.op3_substring_dedup,
        sharding.op4_minimax_sharding,
        mixing.op5_pfair_mixing,
        chat.op6_perspective_rotation,
        classifier.op7_quality_classifier,
        embeddings.op8_int8_embedding_dedup,
        bpe.op9_forced_boundary_bpe,
        warc.op10_warc_zstd,
    )
}
ORACLE_SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_minhash_near_dedup": neardup.SQL,
    "op3_substring_dedup": substring.SQL,
    "op6_perspective_rotation": chat.SQL,
    "op10_warc_zstd": warc.SQL,
}
