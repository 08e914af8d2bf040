"""All queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from larkspur.llm import decontaminate, language_model, packing, pii, secrets, simhash, substrings, token_counts, topk, toxicity

MODULES = [decontaminate, simhash, substrings, token_counts, packing, toxicity, pii, language_model, topk, secrets]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
