"""The queries and the oracle SQL of this package."""

from __future__ import annotations

from . import bpe, chroma, codebooks, ctw, interactions, langid, minhash, mixing, rules, substrings, tiles, token_files, toxicity

QUERIES = {
    "op1_chroma_alignment": chroma.op1,
    "op2_toxicity": toxicity.op2,
    "op3_source_mix": mixing.op3,
    "op4_context_tree": ctw.op4,
    "op5_near_duplicates": minhash.op5,
    "op6_token_files": token_files.op6,
    "op7_repeated_passages": substrings.op7,
    "op8_bpe_round_trip": bpe.op8,
    "op9_language": langid.op9,
    "op10_quality_ledger": rules.op10,
    "rule_ablations": rules.rule_ablations,
    "op11_vector_codes": codebooks.op11,
    "op12_filter_interactions": interactions.op12,
    "op13_near_vectors": tiles.op13,
}
SQL = {
    "op3_source_mix": mixing.OP3_SQL,
    "op5_near_duplicates": minhash.OP5_SQL,
    "op7_repeated_passages": substrings.OP7_SQL,
    "op10_quality_ledger": rules.OP10_SQL,
    "rule_ablations": rules.ABLATIONS_SQL,
    "op11_vector_codes": codebooks.OP11_SQL,
    "op12_filter_interactions": interactions.OP12_SQL,
    "op13_near_vectors": tiles.OP13_SQL,
}
