"""Conditional aggregation (EAV long rows → one column per parameter)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_params(df: DataFrame, keys: Sequence[str], param: str, value: str,
                 columns: Sequence[tuple[str, Sequence[str] | str]], agg: str = "max") -> DataFrame:
    """``MAX(IF(param IN (names…), value, NULL)) AS column`` for each ``(column, names)``.

    A fixed column list (never a data-driven ``pivot()`` without values) keeps the schema stable
    and the plan to one hash aggregate with partial aggregation. ``max`` over text compares
    lexicographically, as the warehouse does.
    """
    fn = {"max": F.max, "min": F.min, "sum": F.sum, "first": F.first}[agg]
    exprs = []
    for col_name, names in columns:
        names = [names] if isinstance(names, str) else list(names)
        cond = F.col(param).isin(names) if len(names) > 1 else (F.col(param) == F.lit(names[0]))
        exprs.append(fn(F.when(cond, F.col(value))).alias(col_name))
    return df.groupBy(*keys).agg(*exprs)
