"""The queries of the operators and their SQL twins."""

from __future__ import annotations

from importlib import import_module

OPERATORS = (
    "word_pieces",
    "line_frequency",
    "line_spread",
    "licenses",
    "mixing",
    "chunk_dedup",
    "templates",
    "html_blocks",
    "jaccard_join",
    "token_shards",
    "conversations",
    "hard_negatives",
    "fingerprints",
)

QUERIES: dict = {}
SQL: dict[str, str] = {}

for _name in OPERATORS:
    _module = import_module(f"portmesh.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
