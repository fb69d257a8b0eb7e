"""The queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: module. A module has ``query(spark, sf_dir)`` and, where SQL can express the result, ``ORACLE``.
MODULES = {
    "op1_audio_features": "audio",
    "op2_token_ids": "token_ids",
    "op3_shards": "shards",
    "op4_top_k": "topk",
    "op5_simhash": "simhash",
    "op6_neighbour_quality": "neighbours",
    "op7_subword_lattice": "lattice",
    "op8_mixture": "mixture",
    "op9_byte_bpe": "byte_bpe",
    "op10_secrets": "secrets",
    "op11_spelling_variants": "spelling",
    "op12_importance_resampling": "importance",
    "op13_line_dedup": "linededup",
}


def _modules():
    return {name: import_module(f"lectern.llm.{module}") for name, module in MODULES.items()}


def queries():
    return {name: module.query for name, module in _modules().items()}


def oracle_sql():
    return {name: module.ORACLE for name, module in _modules().items() if getattr(module, "ORACLE", None)}
