"""``STRING_AGG`` with a defined (sorted) order, computed in two levels.

A sorted list with duplicates is fully described by its distinct values and their multiplicities.
Aggregating per ``(key, value)`` first (partial aggregation before the shuffle) and expanding the
small ``(value, count)`` set per key gives exactly ``listagg(value, sep) WITHIN GROUP (ORDER BY
value)`` while a key's buffer holds its *distinct* values, not every row. Additive aggregates
(sums and counts) ride along through both levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_values(df: DataFrame, keys: Sequence[str], value: Column | str, *, sums: dict[str, Column | str] | None = None,
                   weight: str | None = None) -> DataFrame:
    """The list of ``grouped_sorted_list`` as rows ``(keys, _v, _n, sums)``: one per distinct value with its
    count (``weight`` names a column of counts when a row stands for several). Nothing is gathered per
    key, so a key may have any number of values."""
    v = (F.col(value) if isinstance(value, str) else value).cast("string")
    sums = sums or {}
    n = F.col(weight) if weight else F.lit(1)
    base = df.select(*keys, v.alias("_v"), F.when(v.isNotNull(), n).otherwise(0).cast("bigint").alias("_w"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_s_{n}") for n, c in sums.items()])
    return base.groupBy(*keys, "_v").agg(F.sum("_w").alias("_n"), *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums])


def grouped_sorted_list(df: DataFrame, keys: Sequence[str], value: Column | str, name: str, *, sep: str = ",",
                        count_name: str | None = None, sums: dict[str, Column | str] | None = None,
                        weight: str | None = None) -> DataFrame:
    """``SELECT keys, STRING_AGG(value ORDER BY value) AS name [, COUNT(value)] [, SUM(x)…] GROUP BY keys``.

    ``value`` is compared as text (cast to string). The list is null when the group has no non-null
    value, like ``listagg``; ``count_name`` counts non-null values; ``sums`` maps output names to
    columns summed per group (null when all inputs are null). The text is the last step and is as long
    as the group's list; take ``grouped_values`` where a group may have more values than a text holds.
    """
    keys = list(keys)
    sums = sums or {}
    lvl1 = grouped_values(df, keys, value, sums=sums, weight=weight)
    pairs = F.filter(F.array_sort(F.collect_list(F.struct(F.col("_v"), F.col("_n")))), lambda p: p["_v"].isNotNull() & (p["_n"] > 0))
    # a value's repeats are written as one text, not as an array with an entry for each
    texts = F.transform(pairs, lambda p: F.concat(F.repeat(F.concat(p["_v"], F.lit(sep)), (p["_n"] - 1).cast("int")), p["_v"]))
    total = F.sum("_n")
    aggs = [F.when(total > 0, F.array_join(texts, sep)).alias(name)]
    if count_name:
        aggs.append(total.alias(count_name))
    aggs += [F.sum(f"_s_{n}").alias(n) for n in sums]
    return lvl1.groupBy(*keys).agg(*aggs)
