"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_split", "q_bpe", "q_turns", "q_sentences", "q_neighbours", "q_mixing", "q_pii", "q_language")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _m = import_module(f"murmura.llm.{_name}")
    QUERIES.update(_m.QUERIES)
    SQL.update(_m.SQL)
