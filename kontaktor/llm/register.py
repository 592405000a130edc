"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, licenses, lm, neardup, packing, quality, secrets, topk, toxicity

MODULES = [licenses, packing, chat, secrets, quality, neardup, topk, lm, bpe, toxicity]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
