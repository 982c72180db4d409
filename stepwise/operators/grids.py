"""Report dimensions: inline rows, ordered lists, period tables and full report grids.

Inline dimensions come from Python literals; the planner knows their size and broadcasts them when they
are small, so no hint is given that would outlive later joins. Grids are built by exploding literal arrays onto a dimension — a generate,
not a join — and period roll-ups scan the facts once (U02) instead of once per look-back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.operators.ordered import global_dense_rank, positions

# literal tables are lists that a person writes
LARGEST_DIMENSION = 100_000


def inline_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """``UNNEST([STRUCT(…), …])``: a literal table of at most ``LARGEST_DIMENSION`` rows."""
    rows = [tuple(r) for r in rows]
    if len(rows) > LARGEST_DIMENSION:
        raise ValueError(f"{len(rows)} literal rows: read a table of that size instead")
    return spark.createDataFrame(rows, schema)


def inline_values(spark: SparkSession, values: Sequence, name: str, dtype: str = "string",
                  offset_name: str | None = None, start: int = 0) -> DataFrame:
    """``UNNEST([v, …]) AS name [WITH OFFSET AS pos]``; offsets are 0-based like OFFSET."""
    if offset_name:
        return inline_rows(spark, [(v, i + start) for i, v in enumerate(values)], f"{name} {dtype}, {offset_name} int")
    return inline_rows(spark, [(v,) for v in values], f"{name} {dtype}")


def numbered(df: DataFrame, start: int, name: str = "pos", order: Sequence[str] | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER ([ORDER BY order]) + start - 1`` on a table of any size.

    Without ``order`` the numbering follows the table's own row order, which for inline rows is
    the literal order (the only order an unordered ``ROW_NUMBER() OVER ()`` can mean). Such a table must come in
    the same order each time it is read (literal rows, files); order others by their columns.
    """
    if order:
        return positions(df, order, name).withColumn(name, F.col(name).cast("int") + F.lit(start - 1))
    placed = df.withColumn("_mid", F.monotonically_increasing_id())
    return positions(placed, ["_mid"], name).withColumn(name, F.col(name).cast("int") + F.lit(start - 1)).drop("_mid")


def ordered_dim(df: DataFrame, key: str, start: int = 1, name: str = "step_order") -> DataFrame:
    """``DENSE_RANK() OVER (ORDER BY key) + start - 1`` on a table of any size."""
    return global_dense_rank(df, [key], name=name).withColumn(name, F.col(name).cast("int") + F.lit(start - 1))


def rank_by_first(df: DataFrame, key: Column | str, pos: str, name: str = "rank") -> DataFrame:
    """``SELECT key, DENSE_RANK() OVER (ORDER BY MIN(pos)) GROUP BY key`` for any number of keys."""
    k = F.col(key) if isinstance(key, str) else key
    g = df.groupBy(k.alias("_key")).agg(F.min(pos).alias("_first"))
    return global_dense_rank(g, ["_first"], name=name).select("_key", F.col(name).cast("int").alias(name))


def report_grid(dim: DataFrame, **axes: Sequence) -> DataFrame:
    """``dim JOIN axis1 ON TRUE JOIN axis2 ON TRUE …`` for literal axes, as array explodes."""
    out = dim
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


@dataclass(frozen=True)
class Period:
    """One look-back of a period report: label, rank, and the divisor applied to totals."""

    label: str
    rank: int
    divisor: float


def explode_periods(df: DataFrame, membership: Sequence[tuple[Period, Column]], name: str = "period") -> DataFrame:
    """Tag each fact row with every period it belongs to (one pass over the facts, U02).

    ``membership`` pairs each period with the predicate that selects its rows. Rows in no period
    are dropped. The result carries ``name`` (label) and ``_divisor``.
    """
    tags = [F.when(cond, F.struct(F.lit(p.label).alias("l"), F.lit(float(p.divisor)).alias("d")))
            for p, cond in membership]
    arr = F.filter(F.array(*tags), lambda x: x.isNotNull())
    out = df.withColumn("_pt", F.explode(arr))
    return out.withColumn(name, F.col("_pt.l")).withColumn("_divisor", F.col("_pt.d")).drop("_pt")


def union_sources(*dfs: DataFrame) -> DataFrame:
    """U01/U03/U04 ``UNION ALL`` by column name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def per_day(total: Column | str, divisor: float) -> Column:
    """A09 ``SUM(x) / n`` with real division."""
    t = F.col(total) if isinstance(total, str) else total
    return t / F.lit(float(divisor))
