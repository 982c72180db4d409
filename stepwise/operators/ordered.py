"""Skew-safe ordered operators: neighbour lookup, exact ranks, medians, running maxima.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of one key to one task. When one
unit/station holds a third of the data that task is the whole job. The operators here split each
key's ordered sequence into **order buckets** — a deterministic, monotone function of the first
order column (``floor(unix_seconds(t) / width)`` or ``floor(id / width)``) — and work in two levels:

1. inside ``(key, bucket)`` with an ordinary window (bounded by the bucket width), and
2. across buckets with a tiny per-``(key, bucket)`` summary (one row per bucket) whose window per key
   holds at most ``span / width`` rows, joined back on ``(key, bucket)``.

Bucket ids are pure functions of row values, so recomputation after an executor loss yields the
same assignment. Texts have no width: their buckets lie between **splitters**, values taken from a
bounded sample of the column's own rows before the plan is built and written into it as literals
(``splitters``). Joins back on ``(key, bucket)`` reuse the window's hash partitioning of the large side,
so only the summary is shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DateType, DoubleType, FloatType, NumericType, StringType,
                               TimestampNTZType, TimestampType)

_B = "_ob"  # bucket column
#: rows sampled for splitters, buckets made from a full sample, sampled rows per bucket of a smaller one, and the
#: characters kept of a text splitter behind the prefix that all values share
SAMPLE, BUCKETS, SAMPLED_PER_BUCKET, SPLITTER_LENGTH = 65_536, 1_024, 1_024, 200
#: rows sampled for hot keys, and the sampled rows that make a key hot
HOT_SAMPLE, HOT_ROWS = 8_192, 16


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def splitters(df: DataFrame, cols: Sequence[str], distinct: bool = False) -> list[Column]:
    """Rising literals that cut the values of ``cols`` (texts, numbers, dates, …; several columns: structs) into parts
    of about as many rows, or of distinct values. They only balance the parts: any literals give right results.

    The rows of the smallest hashes are the sample, so a frequent range has many splitters and the same rows give the same
    ones. It is bounded by ``SAMPLE`` rows of ``cols``, texts cut to ``SPLITTER_LENGTH`` characters behind the prefix that
    all values share.
    """
    rows = df.select(*cols).distinct() if distinct else df
    texts = [c for c in cols if isinstance(df.schema[c].dataType, (StringType, BinaryType))]
    shared = {}
    if texts:
        ends = df.agg(*[f(F.col(c)).alias(f"{f.__name__}_{i}") for i, c in enumerate(texts) for f in (F.min, F.max)]).first()
        for i, c in enumerate(texts):
            lo, hi = ends[f"min_{i}"], ends[f"max_{i}"]
            shared[c] = lo[: next((k for k, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))] if lo else lo
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    taken = [F.substring(c, len(shared[c] or "") + 1, SPLITTER_LENGTH).alias(c) if c in shared else F.col(c) for c in cols]
    sample = rows.select(*taken, F.xxhash64(*hashed).alias("_h")).orderBy("_h").limit(SAMPLE).drop("_h").collect()
    n = BUCKETS if len(sample) == SAMPLE else len(sample) // SAMPLED_PER_BUCKET
    if n < 2:
        return []
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    whole = lambda c, v: plain(v) if c not in shared or v is None else plain(shared[c] or v[:0]) + plain(v)
    values = [tuple(whole(c, v) for c, v in zip(cols, r)) for r in sample]
    values = sorted(set(values), key=lambda v: tuple((x is not None, x != x, 0 if x is None or x != x else x) for x in v))
    literal = lambda c, v: F.lit(v).cast(df.schema[c].dataType)
    picked = [values[k * len(values) // n] for k in range(1, min(n, len(values)))]
    picked = [v for v, w in zip(picked, [None, *picked]) if v != w and (len(cols) > 1 or v[0] is not None)]
    return [F.struct(*[literal(c, x).alias(c) for c, x in zip(cols, v)]) if len(cols) > 1 else literal(cols[0], v[0]) for v in picked]


def between_splitters(value: Column, cuts: Sequence[Column]) -> Column:
    """How many of the rising ``cuts`` are at most ``value``, by halving (nulls: 0)."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    table = F.array(*cuts)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def positions(df: DataFrame, order: Sequence[str], name: str, distinct: bool = False) -> DataFrame:
    """Exact 1-based ``ROW_NUMBER() OVER (ORDER BY order)`` over all rows without a window over all rows: row numbers
    between splitters plus the counts of the parts before. ``distinct``: of the distinct ``order`` tuples, alone."""
    order = _names(order)
    cuts = splitters(df, order, distinct)
    rows = df.select(*order).distinct() if distinct else df
    value = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    parts = rows.withColumn("_part", between_splitters(value, cuts))
    own = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_part").alias("_cp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = parts.withColumn("_own", F.row_number().over(own))
    return numbered.join(counts, F.col("_part") == F.col("_cp")).select(
        *[F.col(f"`{c}`") for c in rows.columns], (F.col("_own") + F.col("_before")).alias(name))


# bucket of NaN: after every number, as Spark orders it
_NAN_BUCKET = (1 << 63) - 1


def order_bucket(df: DataFrame, col: str, width) -> Column:
    """Monotone bucket id of ``col``: timestamps by seconds, dates by days, numbers by value (NaN last),
    texts and binaries by splitters of their own (``width`` doesn't matter; a sample is read at once). Nulls
    have a null bucket, or the first one. Other types have no bucket and are refused."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(int(width * 1_000_000)))
    if isinstance(dt, DateType):
        return F.floor(F.unix_date(c) / F.lit(width))
    if isinstance(dt, (DoubleType, FloatType)):
        return F.when(F.isnan(c), F.lit(_NAN_BUCKET)).otherwise(F.floor(c / F.lit(width)))
    if isinstance(dt, NumericType):
        return F.floor(c / F.lit(width))
    if isinstance(dt, BooleanType):
        return c.cast("bigint")
    if isinstance(dt, (StringType, BinaryType)):
        return between_splitters(c, splitters(df, [col]))
    raise TypeError(f"no order bucket for {dt.simpleString()} column {col}")


_K = "_k"    # struct of the partition keys: one non-null column; nulls inside compare equal, as in GROUP BY
_G = "_gk"   # struct(_k, bucket): the plain equi-join key of a (key, bucket) group


def _keyed(df: DataFrame, keys: Sequence[str], order_col: str, width) -> DataFrame:
    """Add the bucket, the key struct and the (key, bucket) struct.

    Windows partition by ``_gk`` and summaries join back on ``_gk`` with ordinary equality, so the
    large side keeps the hash partitioning of its window exchange (a null-safe join on the separate
    columns would rewrite the keys and shuffle the large side a second time).
    """
    b = df.withColumn(_B, order_bucket(df, order_col, width))
    k = F.struct(*[F.col(c) for c in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    return b.withColumn(_K, k).withColumn(_G, _group_key(_K, _B))


def _group_key(k_col: str, b_col: str) -> Column:
    return F.struct(F.col(k_col).alias("k"), F.col(b_col).alias("b"))


def hot_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Whether a row's key holds more than about a 500th of the rows, by a sample (a scalar subquery): of the ``HOT_SAMPLE``
    rows with the smallest hashes, those keys that have ``HOT_ROWS``. It only balances the parts: any answer that is the same
    for all rows of a key gives right results."""
    key = F.xxhash64(*[F.col(c) for c in keys])
    sample = df.select(key.alias("_h"), F.xxhash64(*[F.col(c) for c in [*keys, *order]]).alias("_o")).orderBy("_o").limit(HOT_SAMPLE)
    hot = sample.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= HOT_ROWS).select(F.collect_set("_h"))
    return F.array_contains(hot.scalar(), key)


def shift_within(df: DataFrame, keys, order: Sequence[str], values: Sequence[str], *, offset: int = 1,
                 width=86400, prefix: str = "next_", hot_only: bool = False) -> DataFrame:
    """``LEAD``/``LAG`` of ``values`` by one row per ``keys`` in ``order`` — skew-safe.

    ``offset=1`` is ``LEAD``, ``offset=-1`` is ``LAG``. ``order`` is completed with ``values`` as
    tie-breakers so that the within-bucket window and the cross-bucket boundary agree. ``width`` is
    the bucket size in units of the first order column (seconds for timestamps).
    Adds columns ``prefix + v`` for each value.
    """
    if offset not in (1, -1):
        raise ValueError("offset must be 1 (lead) or -1 (lag)")
    return neighbours(df, keys, order, values, width=width, hot_only=hot_only, **{"next_prefix" if offset == 1 else "prev_prefix": prefix})


def neighbours(df: DataFrame, keys, order: Sequence[str], values: Sequence[str], *, width=86400,
               next_prefix: str | None = None, prev_prefix: str | None = None, hot_only: bool = False) -> DataFrame:
    """``LEAD`` (``next_prefix + v``) and ``LAG`` (``prev_prefix + v``) of ``values``, either or both, as in
    ``shift_within``. The input is read and shuffled once: the rows at the ends of the buckets come from the same
    exchange as the windows (both need the same columns, so Spark reuses it).

    ``hot_only``: only the buckets of keys that hold many of the rows are kept apart. Where a bucket holds a row or two of
    an ordinary key, nearly every row is at an end and would be shuffled twice more; so an ordinary key has two ends in all.
    """
    keys, order, values = _names(keys), _names(order), _names(values)
    sort_cols = order + [c for c in values if c not in order]
    b = _keyed(df, keys, order[0], width)
    if hot_only and keys:
        b = b.withColumn(_G, F.struct(F.col(_K).alias("k"), F.when(hot_keys(df, keys, order), F.col(_B)).alias("b")))
    b = b.drop(_K, _B)
    w = Window.partitionBy(_G).orderBy(*[F.col(c).asc_nulls_first() for c in sort_cols])
    sides = [(p, f, e) for p, f, e in ((next_prefix, F.lead, "_last"), (prev_prefix, F.lag, "_first")) if p is not None]
    shifted = [f(F.col(v), 1).over(w).alias(p + v) for p, f, _ in sides for v in values]
    local = b.select("*", *shifted, F.lag(F.lit(1), 1).over(w).isNull().alias("_first"), F.lead(F.lit(1), 1).over(w).isNull().alias("_last"))

    # first and last row of every bucket; the neighbouring bucket's end is the neighbour of a bucket's end
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    edges = b.select("*", F.lag(F.lit(1), 1).over(w).isNull().alias("_first"), F.lead(F.lit(1), 1).over(w).isNull().alias("_last"))
    ends = edges.filter("_first or _last").groupBy(_G).agg(F.first(F.when(F.col("_first"), row), True).alias("_head"),
                                                           F.first(F.when(F.col("_last"), row), True).alias("_tail"))
    wn = Window.partitionBy(f"{_G}.k").orderBy(F.col(f"{_G}.b").asc_nulls_first())
    near = [F.lead("_head", 1).over(wn).alias("_after")] * (next_prefix is not None) + [F.lag("_tail", 1).over(wn).alias("_before")] * (prev_prefix is not None)
    joined = local.join(ends.select(_G, *near), _G, "left")
    out = [F.col(f"`{c}`") for c in df.columns]
    for p, f, edge in sides:
        other = "_after" if f is F.lead else "_before"
        out += [F.when(F.col(edge), F.col(f"{other}.`{v}`")).otherwise(F.col(f"`{p + v}`")).alias(p + v) for v in values]
    return joined.select(*out)


def ordered_rank(df: DataFrame, keys, order: Sequence[str], *, width, name: str = "_rank",
                 count_name: str | None = None) -> DataFrame:
    """Exact 1-based ``ROW_NUMBER() OVER (PARTITION BY keys ORDER BY order)`` — skew-safe.

    Row numbers inside ``(key, bucket)`` plus the count of rows in earlier buckets of the key
    (a running sum over the per-bucket counts). Ties are broken by the remaining ``order`` columns;
    give enough columns for a total order if the numbering must be reproducible.
    Optionally adds the per-key row count as ``count_name``.
    """
    keys = _names(keys)
    order = _names(order)
    b = _keyed(df, keys, order[0], width)
    w = Window.partitionBy(_G).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = b.withColumn("_lrn", F.row_number().over(w))
    counts = b.groupBy(_K, _B).agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(_K).orderBy(F.col(_B).asc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(wk), F.lit(0)))
    if count_name:
        counts = counts.withColumn(count_name, F.sum("_n").over(Window.partitionBy(_K)))
    counts = counts.select(_group_key(_K, _B).alias(_G), "_before", *([count_name] if count_name else []))
    joined = local.join(counts, _G, "left")
    out = [F.col(c) for c in df.columns] + [(F.col("_lrn") + F.col("_before")).alias(name)]
    if count_name:
        out.append(F.col(count_name))
    return joined.select(*out)


def median_over(df: DataFrame, keys, value: str, *, width, name: str = "median") -> DataFrame:
    """``PERCENTILE_CONT(value, 0.5) OVER (PARTITION BY keys)`` on every row — exact and skew-safe.

    Rows are counted per ``(key, value bucket)``; running sums over those counts name the one or two
    buckets that hold the middle ranks. Only their rows are looked at again, pre-counted per distinct
    value, so a value repeated a million times is one row. Nothing is sorted as a whole and no group is
    collected. NaN counts as the largest value; the one-row-per-key result is joined back.
    """
    keys = _names(keys)
    vals = _keyed(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, value, width)
    counts = vals.groupBy(_K, _B).agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(_K).orderBy(F.col(_B).asc())
    counts = counts.withColumn("_upto", F.sum("_n").over(wk)).withColumn("_cnt", F.sum("_n").over(Window.partitionBy(_K)))
    pos = F.lit(1.0) + F.lit(0.5) * (F.col("_cnt") - 1)
    counts = counts.withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos)).withColumn("_frac", pos - F.floor(pos))
    middle = counts.filter((F.col("_upto") >= F.col("_lo")) & (F.col("_upto") - F.col("_n") < F.col("_hi"))).select(
        _group_key(_K, _B).alias(_G), F.col(_K).alias("_mk"), (F.col("_upto") - F.col("_n")).alias("_before"), "_lo", "_hi", "_frac")
    same = vals.select(_G, value).join(middle, _G).groupBy(_G, "_mk", "_before", "_lo", "_hi", "_frac", value).agg(
        F.count(F.lit(1)).alias("_m"))
    wv = Window.partitionBy(_G).orderBy(F.col(value).asc())
    same = same.withColumn("_last", F.col("_before") + F.sum("_m").over(wv))
    holds = lambda rank: (F.col("_last") >= F.col(rank)) & (F.col("_last") - F.col("_m") < F.col(rank))
    med = same.groupBy(F.col("_mk").alias(_K)).agg(
        F.max(F.when(holds("_lo"), F.col(value))).alias("_vlo"), F.max(F.when(holds("_hi"), F.col(value))).alias("_vhi"),
        F.max("_frac").alias("_frac"))
    between = F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))
    med = med.select(_K, F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(between).cast("double").alias(name))
    d = df.withColumn(_K, F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all")))
    return d.join(med, _K, "left").select(*[F.col(c) for c in df.columns], F.col(name))


def global_dense_rank(df: DataFrame, order: Sequence[str], *, width=None, name: str = "dense_rank",
                      bucket_col: str | None = None) -> DataFrame:
    """``DENSE_RANK() OVER (ORDER BY order…)`` without a window over all rows.

    The distinct order tuples are numbered between splitters of their own (``positions``) and joined back to every
    row. No task orders more than the tuples of one part or the ``BUCKETS`` part counts. ``width`` and ``bucket_col`` are
    taken for older callers and no longer matter.
    """
    order = _names(order)
    ranked = positions(df, order, name, distinct=True)
    ranked = ranked.select(F.struct(*[F.col(c) for c in order]).alias("_ot"), name)
    d = df.withColumn("_ot", F.struct(*[F.col(c) for c in order]))
    return d.join(ranked, "_ot", "left").select(*[F.col(c) for c in df.columns], F.col(name))


def running_max_before(df: DataFrame, keys, order: str, value: str, probe: str, *, width,
                       name: str = "prev_max") -> DataFrame:
    """For every row, ``max(value)`` over rows of the same key strictly earlier in ``order``.

    Rows with ``probe`` true sort before other rows at an equal ``order`` value, so their result
    only covers strictly smaller orders. Two levels: running max inside ``(key, bucket)`` and the
    maximum of all earlier buckets of the key, taken from the one-row-per-bucket summary.
    """
    keys = _names(keys)
    side = F.when(F.col(probe), 0).otherwise(1)
    b = _keyed(df, keys, order, width).withColumn("_side", side)
    w = Window.partitionBy(_G).orderBy(F.col(order).asc_nulls_first(), F.col("_side").asc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumn("_lmax", F.max(value).over(w))
    summ = b.groupBy(_K, _B).agg(F.max(value).alias("_bmax"))
    wk = Window.partitionBy(_K).orderBy(F.col(_B).asc()).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_carry", F.max("_bmax").over(wk)).select(_group_key(_K, _B).alias(_G), "_carry")
    joined = local.join(summ, _G, "left")
    res = F.greatest(F.col("_lmax"), F.col("_carry"))  # greatest skips nulls: max of both parts
    return joined.select(*[F.col(c) for c in df.columns], res.alias(name))


def next_value(df: DataFrame, keys, order: Sequence[str], value: str, *, width, name: str | None = None) -> DataFrame:
    """W01 ``LEAD(value) OVER (PARTITION BY keys ORDER BY order)`` (skew-safe)."""
    out = shift_within(df, keys, order, [value], offset=1, width=width, prefix="_next_")
    return out.withColumnRenamed(f"_next_{value}", name or f"next_{value}")


def prev_value(df: DataFrame, keys, order: Sequence[str], value: str, *, width, name: str | None = None,
               hot_only: bool = False) -> DataFrame:
    """W02 ``LAG(value) OVER (PARTITION BY keys ORDER BY order)`` (skew-safe)."""
    out = shift_within(df, keys, order, [value], offset=-1, width=width, prefix="_prev_", hot_only=hot_only)
    return out.withColumnRenamed(f"_prev_{value}", name or f"last_{value}")


def delta_from_prev(df: DataFrame, value: str, keys, order: Sequence[str], *, width, name: str = "change_of_value") -> DataFrame:
    """W03 ``value - LAG(value)``; apply row filters *after* this call (the window sees all rows)."""
    out = prev_value(df, keys, order, value, width=width, name="_prev_for_delta", hot_only=True)
    return out.withColumn(name, F.col(value) - F.col("_prev_for_delta")).drop("_prev_for_delta")


def with_global_max(df: DataFrame, col: str, name: str) -> DataFrame:
    """W11 ``MAX(col) OVER ()`` on every row as a scalar subquery (one partial aggregate, no
    single-partition window, no cross join)."""
    return df.withColumn(name, df.select(F.max(col)).scalar())
