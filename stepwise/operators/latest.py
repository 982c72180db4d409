"""Latest / first row per key.

All three shapes pre-aggregate (partial aggregation before the shuffle) instead of ranking with a
``Window.partitionBy(key)``, so a key holding a third of the rows never lands in one task:

* ``latest_per_key`` — ``MAX(order) GROUP BY key`` joined back: keeps *every* row tied on the
  latest order (the warehouse join-back semantics), and the chooser may filter differently from
  the fetched rows.
* ``first_per_key`` — ``MIN(order) GROUP BY key``.
* ``top_row_per_key`` — ``QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY order DESC) = 1``
  as ``max(struct(order, tie-breakers…))``; ties are broken deterministically by the given columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def latest_per_key(df: DataFrame, keys, order: str, *, chooser: Column | None = None,
                   fetch_from: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Rows of ``fetch_from`` (default ``df``) whose ``order`` equals the per-key maximum.

    ``chooser`` filters only the rows that pick the maximum (T9b); fetched rows are not filtered.
    Ties on the maximum are all kept. ``name`` optionally renames the picked order column.
    """
    keys = _names(keys)
    src = df if chooser is None else df.filter(chooser)
    picked = src.groupBy(*keys).agg(F.max(order).alias(order))
    target = fetch_from if fetch_from is not None else df
    out = target.join(picked, keys + [order], "inner")
    if name:
        out = out.withColumnRenamed(order, name)
    return out


def max_per_key(df: DataFrame, keys, order: str, name: str | None = None) -> DataFrame:
    """``SELECT keys, MAX(order) GROUP BY keys``."""
    return df.groupBy(*_names(keys)).agg(F.max(order).alias(name or order))


def first_per_key(df: DataFrame, keys, order: str, name: str | None = None) -> DataFrame:
    """``SELECT keys, MIN(order) GROUP BY keys``."""
    return df.groupBy(*_names(keys)).agg(F.min(order).alias(name or order))


def top_row_per_key(df: DataFrame, keys, order: Sequence[str], values: Sequence[str],
                    descending: bool = True) -> DataFrame:
    """One row per key: the row with the greatest (``descending``) or least ``order`` tuple.

    ``values`` are carried along and also break ties (greatest/least first), so the pick is
    deterministic. Rows whose first order column is null lose to any non-null one (SQL
    ``ORDER BY … DESC`` puts nulls last; ``ASC`` puts them first and they are then preferred,
    as in Spark and BigQuery).
    """
    keys = _names(keys)
    order = _names(order)
    values = [v for v in _names(values) if v not in order and v not in keys]
    packed = F.struct(*[F.col(c) for c in order + values])
    agg = F.max(packed) if descending else F.min(packed)
    picked = df.groupBy(*keys).agg(agg.alias("_top"))
    return picked.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in order + values])
