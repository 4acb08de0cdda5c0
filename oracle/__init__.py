"""DuckDB SQL for every key whose result plain SQL can express."""

from __future__ import annotations


def all_queries() -> dict[str, str]:
    from oracle import analysis, business, cleaning, measures, scored

    merged: dict[str, str] = {}
    for module in (business, cleaning, analysis, measures, scored):
        merged.update(module.QUERIES)
    return merged
