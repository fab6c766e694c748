"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from plumbline.suite import catalog, evaluation, lineage, models, primitives, profiles, quality, runs

FLAGSHIP = "q11_run_improved_ruleset"
_GROUPS = (models, quality, lineage, runs, profiles, evaluation, catalog, primitives)


def queries() -> dict:
    return {name: run for group in _GROUPS for name, run in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for group in _GROUPS for name, text in group.ORACLE.items()}
