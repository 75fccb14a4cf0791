"""The subpackage's queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, language, minhash, mixing, pii, polytope, quality, sharding, toxicity

def pipeline(spark, sf_dir: str):
    """All stages of corpus_pipeline.py over `documents`."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_mixing": mixing.op1_mixing,
    "op2_chat": chat.op2_chat,
    "op3_polytope": polytope.op3_polytope,
    "op4_pii": pii.op4_pii,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language": language.op7_language,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_bpe": bpe.op9_bpe,
    "op10_minhash": minhash.op10_minhash,
}

ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op8_quality_rules": quality.OP8_SQL,
}
