"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.llm import gru, hamming, jaccard, licences, lines, mixing, pieces, secrets, toxicity, vectors

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_secrets": secrets.op2_secrets,
    "op3_pieces": pieces.op3_pieces,
    "op4_gru": gru.op4_gru,
    "op5_hamming": hamming.op5_hamming,
    "op6_vectors": vectors.op6_vectors,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_licences": licences.op9_licences,
    "op10_jaccard": jaccard.op10_jaccard,
    "licence_base": licences.licence_base,
}

SQL = {
    "op2_secrets": secrets.OP2_SQL,
    "op5_hamming": hamming.OP5_SQL,
    "op6_vectors": vectors.OP6_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
    "licence_base": licences.BASE_SQL,
}
