"""Helpers that render Python parameters as SQL literals for oracle queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def str_list(values: Iterable[str]) -> str:
    """A DuckDB list literal ``['a', 'b']``."""
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values: Iterable[str]) -> str:
    """An IN-list body ``'a', 'b'``."""
    return ", ".join(q(v) for v in values)


def taxonomy_values(taxonomy: Mapping[str, Sequence[str]]) -> str:
    """``VALUES`` rows for ``(category, cat_ord, sub_category, sub_ord)``."""
    from ..taxonomy import taxonomy_rows
    rows = []
    for cat, cat_ord, sub, sub_ord in taxonomy_rows(taxonomy):
        rows.append(f"({q(cat)}, CAST({cat_ord} AS INTEGER), CAST({q(sub)} AS VARCHAR), "
                    f"CAST({'NULL' if sub_ord is None else sub_ord} AS INTEGER))")
    return ", ".join(rows)


def rule_values(rules: Mapping[str, Sequence[str]]) -> str:
    from ..taxonomy import rule_rows
    return ", ".join(f"({q(t)}, CAST({o} AS INTEGER), {q(p)})" for t, o, p in rule_rows(rules))
