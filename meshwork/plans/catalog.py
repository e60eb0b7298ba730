"""All registered queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from . import edition_queries, free_queries, grounding_queries, history_queries, layer_queries, name_queries, pair_queries, place_queries, record_queries, registry_queries, resolution_queries, rule_queries, text_queries

MODULES = [pair_queries, text_queries, edition_queries, place_queries, record_queries, registry_queries, resolution_queries, rule_queries, layer_queries, grounding_queries, history_queries, name_queries, free_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("AS STRING", "AS VARCHAR") for m in MODULES for k, v in m.SQL.items()}
