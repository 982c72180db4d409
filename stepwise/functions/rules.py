"""Ordered rule lists turned into ``CASE`` expressions (first match wins, no ELSE gives null)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Searched ``CASE WHEN p1 THEN v1 … [ELSE default] END``; values may be literals or columns."""
    if not rules:
        return F.lit(default)
    expr = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    if default is not None:
        expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return expr


@dataclass
class Alias:
    """One canonical name reached by a value list and/or LIKE patterns."""

    name: str
    values: Sequence[str] = field(default_factory=tuple)
    like: Sequence[str] = field(default_factory=tuple)


def canonicalise(c, aliases: Sequence[Alias], keep_unmatched: bool = True) -> Column:
    """``CASE WHEN x IN (…) THEN name WHEN x LIKE … THEN name … ELSE x END`` in the given order."""
    col = F.col(c) if isinstance(c, str) else c
    rules = []
    for a in aliases:
        cond = None
        if a.values:
            cond = col.isin(list(a.values))
        for p in a.like:
            cond = col.like(p) if cond is None else (cond | col.like(p))
        if cond is not None:
            rules.append((cond, a.name))
    return classify(rules, col if keep_unmatched else None)


def alias_values(c, mapping: dict[str, str]) -> Column:
    """``CASE WHEN x = 'a' THEN 'b' … ELSE x END`` from a small literal map."""
    col = F.col(c) if isinstance(c, str) else c
    return classify([(col == F.lit(k), v) for k, v in mapping.items()], col)
