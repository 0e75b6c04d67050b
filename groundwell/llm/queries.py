"""The training-data queries by name: each module has ``query``, or as the pipeline ``run``, and its SQL if there is any.

Only names stand here, so that one module can be imported without the others.
"""

from __future__ import annotations

#: Query name: module, function, attribute with the SQL (None where SQL can't express it).
REGISTRY: dict[str, tuple[str, str, str | None]] = {
    "op1_substring_dedup": ("groundwell.llm.op1_substring", "query", None),
    "op2_token_binary": ("groundwell.llm.op2_tokens", "query", None),
    "op3_embedding_near_dedup": ("groundwell.llm.op3_embeddings", "query", None),
    "op4_language_id": ("groundwell.llm.op4_language", "query", None),
    "op5_byte_bpe": ("groundwell.llm.op5_bpe", "query", None),
    "op6_decontamination": ("groundwell.llm.op6_decontaminate", "query", "ORACLE"),
    "op7_quality": ("groundwell.llm.op7_quality", "query", None),
    "op8_ngram_jaccard_join": ("groundwell.llm.op8_jaccard", "query", None),
    "op9_secret_scan": ("groundwell.llm.op9_secrets", "query", None),
    "op10_toxicity": ("groundwell.llm.op10_toxicity", "query", None),
    "pipeline": ("corpus_pipeline", "run", "ORACLE_SQL"),
}
