"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

import importlib

#: Query name to (module, function).
PLACES = {
    "op1_quality_gam": "quality_gam",
    "op2_simhash_covering": "simhash",
    "op3_tokeniser_fertility": "rules",
    "op4_recurrent_blocks": "html_blocks",
    "op5_byte_bpe": "bpe",
    "op6_block_neighbours": "knn",
    "op7_length_buckets": "packing",
    "op8_surrogates": "pii",
    "op9_token_counts": "token_counts",
    "op10_secret_entropy": "secrets",
    "op11_importance_csr": "importance",
    "op12_delta_lloyd": "codes",
    "op13_progressive_exact": "exact_dedup",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"sievestone.llm.{module}"), name) for name, module in PLACES.items()}
    return found | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in PLACES.items():
        sql = getattr(importlib.import_module(f"sievestone.llm.{module}"), f"{name.split('_')[0].upper()}_SQL", None)
        if sql:
            found[name] = sql
    return found
