"""Join shapes that need more than ``df.join(other, on)``.

Every operator keeps the equi part of the condition as a hash/sort-merge key so Catalyst never
falls back to a nested-loop join, and bounds the candidate pairs per key (time buckets, argmax
pre-aggregation) so a hot key cannot produce a quadratic fan-out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from stepwise.operators.dyadic import FARTHEST, LastSmaller, bounded, exact_code, levels_of, pieces, with_ancestors
from stepwise.operators.ordered import global_dense_rank, order_bucket, running_max_before


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


# ----------------------------------------------------------------------------- keys and lists

def key_frame(spark, ids, name: str = "id", kind: DataType | None = None) -> DataFrame:
    """An id list as a one-column DataFrame (a Python list, or a DataFrame column). ``kind`` is the type of the column the
    ids are compared with; a list is given that type, so an empty one has it too."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).alias(name)) if name not in ids.columns else ids.select(name)
    ids = list(ids)
    own = "string" if any(isinstance(i, str) for i in ids) or isinstance(kind, StringType) else "bigint"
    if not ids and kind is not None:
        return spark.createDataFrame([], StructType([StructField(name, kind)]))
    return spark.createDataFrame([(str(i) if own == "string" and i is not None else i,) for i in ids], f"{name} {own}")


def in_ids(df: DataFrame, key: str, ids, negate: bool = False) -> DataFrame:
    """``key IN (ids…)`` / ``key NOT IN (ids…)`` as a semi / null-aware anti join.

    Long literal lists are turned into a DataFrame so the planner picks a broadcast semi join for a
    small list and a shuffled one for a large list, instead of an ``InSet`` per row.
    """
    keys = key_frame(df.sparkSession, ids, "_k", df.schema[key].dataType)
    if negate:
        return anti_null_aware(df, keys, key, "_k")
    return df.join(keys.distinct(), df[key] == keys["_k"], "left_semi")


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """``x IN (SELECT …)``: left semi join (duplicates on the right never multiply rows)."""
    return left.join(right, on, "left_semi")


def anti_null_aware(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """``left_key NOT IN (SELECT right_key FROM right)`` with SQL's three-valued logic.

    * a null in the subquery removes every row;
    * a null ``left_key`` survives only when the subquery is empty.

    Built as an ordinary ``left_anti`` join on non-null keys (hash or broadcast, chosen by size)
    plus two scalar aggregates of the right side, so a large list never has to be broadcast.
    """
    right_key = right_key or left_key
    rk = right.select(F.col(right_key).alias("_nk"))
    stats = rk.select(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_nk").isNull()).alias("nn"))).scalar()
    n_all = stats.getField("n")
    n_null = stats.getField("nn")
    non_null = rk.filter(F.col("_nk").isNotNull()).distinct()
    kept = left.join(non_null, left[left_key] == non_null["_nk"], "left_anti")
    return kept.filter((n_null == 0) & (F.col(left_key).isNotNull() | (n_all == 0)))


def join_distinct(left: DataFrame, right: DataFrame, left_on, right_cols: Sequence[str], right_on=None,
                  how: str = "inner") -> DataFrame:
    """Join against a de-duplicated projection of ``right`` (``JOIN (SELECT … GROUP BY …)``)."""
    r = right.select(*right_cols).distinct()
    right_on = right_on or left_on
    cond = [left[a] == r[b] for a, b in zip(_names(left_on), _names(right_on))]
    return left.join(r, cond, how)


# ----------------------------------------------------------------------------- OR join

def any_key_join(small: DataFrame, big: DataFrame, small_keys: Sequence[str], big_key: str,
                 matched_as: str = "_matched_key", how: str = "inner") -> DataFrame:
    """``big JOIN small ON big.k = small.a OR big.k = small.b …`` as an equi join.

    Each small row is exploded to its distinct non-null keys (``array_distinct`` keeps a row whose
    keys coincide from matching twice), then joined on equality. Catalyst would otherwise plan a
    nested-loop join for the ``OR``.
    """
    keyed = small.withColumn(matched_as, F.explode(F.array_distinct(F.array(*[F.col(k) for k in small_keys]))))
    keyed = keyed.filter(F.col(matched_as).isNotNull())
    return big.join(keyed, big[big_key] == keyed[matched_as], how)


# ----------------------------------------------------------------------------- range joins

def interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]], t: str,
                  start: str, end: str, *, width=1, how: str = "inner") -> DataFrame:
    """``points JOIN intervals ON p.k = i.k AND p.t BETWEEN i.start AND i.end``, for intervals of any length.

    An interval becomes at most 17 nodes of one size, chosen by its own length from the doubling sizes of
    ``operators.dyadic``; a point becomes one node per size that some interval uses. The equi key is
    ``(k, size, node)``: a station holding a third of all rows is spread over the nodes of its intervals, and every pair is
    made exactly once. Intervals are first cut to the points' own range, so one that is open to the year 9999 has nodes as
    small as one that ends with the data. ``width`` is the smallest node (seconds for timestamps, days for dates, units
    for numbers). ``how`` is ``inner`` or ``left`` (points without an interval stay): an interval lies in several nodes,
    so outer joins that keep intervals have no meaning here. A null time or end matches nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("interval_join keeps points only: how must be 'inner' or 'left'")
    pb = points.withColumn("_pos", bounded(order_bucket(points, t, width)))
    span = pb.select(F.struct(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"))).scalar()
    iv = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    iv = iv.withColumn("_lo", F.greatest(bounded(order_bucket(iv, start, width)), span.getField("lo"))) \
        .withColumn("_hi", F.least(bounded(order_bucket(iv, end, width)), span.getField("hi"))).filter("_lo <= _hi")
    iv = iv.withColumn("_iv_node", F.explode(pieces(F.col("_lo"), F.col("_hi")))).drop("_lo", "_hi")
    pn = with_ancestors(pb, "_pos", levels_of(iv, "_iv_node.level"), "_pt_node").drop("_pos")
    cond = [pn[a] == iv[b] for a, b in on] + [pn["_pt_node"] == iv["_iv_node"], pn[t] >= iv[start], pn[t] <= iv[end]]
    met = pn.join(iv, cond, "inner")
    joined = met.drop("_pt_node", "_iv_node")
    if how == "inner":
        return joined
    # whether a point has an interval depends on its key and time only
    same = list(dict.fromkeys([a for a, _ in on] + [t]))
    known = met.select(*[pn[c].alias(f"_m{i}") for i, c in enumerate(same)]).distinct()
    alone = points.join(known, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(same)], "left_anti")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in intervals.schema]
    return joined.union(alone.select(*[points[c] for c in points.columns], *nulls))


def offset_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], condition: Column,
                how: str = "inner") -> DataFrame:
    """Equi join plus a residual bound such as ``l.t < r.first + 10 minutes``.

    Use when one side has one row per key (a per-key minimum/maximum), so the residual never has
    to filter a quadratic candidate set.
    """
    cond = [left[a] == right[b] for a, b in on]
    return left.join(right, cond + [condition], how)


# ----------------------------------------------------------------------------- as-of join

def latest_before(left: DataFrame, right: DataFrame, *, by: Sequence[str], combos: Sequence[str],
                  left_id: str, right_id: str, left_time: str, right_time: str, width,
                  name: str = "last_id", materialize: bool = False) -> DataFrame:
    """For each left row and each ``combos`` value present for its ``by`` key: the largest
    ``right_id`` with ``right_id < left_id`` **and** ``right_time < left_time`` (or null).

    Exact for any agreement of ids and times, nulls in ``by`` and ``combos`` included (equal nulls are
    one key, as in GROUP BY):

    1. Fast path: a skew-safe running maximum of ``right_id`` over the union of both sides ordered by
       id (``running_max_before``) gives ``c1 = max{r.id < l.id}``. When ``c1``'s time is also
       earlier than ``left_time`` it is the answer.
    2. Exceptions (``c1`` exists but is not earlier in time) walk a tree over the key's ids whose nodes hold
       their least times (``dyadic.LastSmaller``): one row per level up and one down, at most 22 in all,
       whether their key has ten ids or ten billion. No row meets the candidates of a bucket.

    Ids without an exact integer code (texts, fractions) or of more than 61 bits' range take their dense rank
    as code. ``width`` buckets ids for the running maximum only.

    Returns ``left`` columns + ``combos`` + ``name`` for every (left row, combo) with a match.
    The candidate rows feed both the fast path and the fallback; ``materialize=True`` writes them
    once as a reliable checkpoint (shared checkpoint folder) instead of computing them twice.
    """
    by = _names(by)
    combos = _names(combos)
    keys = by + combos
    l_cols = left.columns
    # each left row is repeated for the (small) set of combos seen on its key
    combo_set = right.select(F.struct(*[F.col(c) for c in by]).alias("_by"), *combos).distinct()
    lx = left.withColumn("_by", F.struct(*[F.col(c) for c in by])).join(combo_set, "_by").drop("_by")
    # candidates carry their time: max(struct(id, time)) orders by id, so the running maximum
    # returns the id-order candidate together with its time (no separate lookup join)
    cand_type = StructType([StructField("_rid", right.schema[right_id].dataType),
                            StructField("_rt", right.schema[right_time].dataType)])
    lrows = lx.select(*keys, F.col(left_id).alias("_id"), F.lit(None).cast(cand_type).alias("_rv"),
                      F.lit(True).alias("_probe"), F.struct(*[F.col(c) for c in l_cols]).alias("_row"))
    rrows = right.select(*keys, F.col(right_id).cast(left.schema[left_id].dataType).alias("_id"),
                         F.struct(F.col(right_id).alias("_rid"), F.col(right_time).alias("_rt")).alias("_rv"),
                         F.lit(False).alias("_probe"), F.lit(None).cast(lrows.schema["_row"].dataType).alias("_row"))
    scanned = running_max_before(lrows.unionByName(rrows), keys, "_id", "_rv", "_probe", width=width, name="_cand")
    lt = F.col(f"_row.{left_time}")
    checked = scanned.filter(F.col("_probe")).select(
        *keys, "_row", F.col("_cand._rid").alias("_c1"),
        (F.col("_cand").isNull() | (F.col("_cand._rt") < lt)).alias("_ok"))
    if materialize:
        from stepwise.operators.tree import materialize as _materialize
        checked = _materialize(checked)
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    probes, found = _exceptions(checked.filter(~ok), right, keys, left_id, right_id, left_time, right_time, width)
    on = ["_key", "_id", "_lt"]
    late = probes.join(found, on, "left").select(*keys, "_row", F.col("_best").alias("_answer"))
    res = checked.filter(ok).select(*keys, "_row", F.col("_c1").alias("_answer")).unionByName(late)
    return res.select(*[F.col(f"_row.{c}").alias(c) for c in l_cols], *[F.col(k) for k in combos], F.col("_answer").alias(name))


def _exceptions(bad: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, left_time: str,
                right_time: str, width) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``bad`` with ``_key``, ``_id``, ``_lt``; the answers (_key, _id, _lt, _best) of those that have one)."""
    key = F.struct(*[F.col(c) for c in keys])
    kind = bad.schema["_row"].dataType[left_id].dataType
    bad = bad.withColumn("_key", key).withColumn("_id", F.col(f"_row.{left_id}")).withColumn("_lt", F.col(f"_row.{left_time}"))
    wanted = bad.select("_key", "_id", "_lt").where("_id is not null and _lt is not null").distinct()
    cand = right.select(key.alias("_key"), F.col(right_id).cast(kind).alias("_id"), F.col(right_id).alias("_best"),
                        F.col(right_time).alias("_t")).where("_id is not null and _t is not null")
    code, ends = exact_code(cand, "_id"), None
    if code is not None:
        ends = cand.agg(F.min(code), F.max(code)).first()
        if ends[0] is not None and ends[1] - ends[0] >= FARTHEST:
            code = None
    if code is None:
        ids = global_dense_rank(cand.select("_id").union(wanted.select("_id")).distinct(), ["_id"], width=width, name="_code")
        cand, wanted = cand.join(ids, "_id"), wanted.join(ids, "_id")
        first, last = 0, ids.agg(F.max("_code")).first()[0] or 0
    else:
        first, last = ends[0] or 0, ends[1] or 0
        # a probe beyond all candidates sees them all, one before them none
        cand = cand.withColumn("_code", code - F.lit(first))
        wanted = wanted.withColumn("_code", F.least(F.greatest(exact_code(wanted, "_id"), F.lit(first)), F.lit(last + 1)) - F.lit(first))
        last = last + 1 - first
    leaves = cand.select(F.col("_key").alias("key"), F.col("_code").alias("code"), F.col("_t").alias("value"), F.col("_best").alias("item"))
    tree = LastSmaller(leaves, last)
    found = tree.find(wanted.select(F.col("_key").alias("key"), F.col("_code").alias("code"), F.col("_lt").alias("bound")).distinct())
    answers = wanted.join(found, (F.col("_key") == F.col("key")) & (F.col("_code") == F.col("code")) & (F.col("_lt") == F.col("bound")))
    return bad, answers.select("_key", "_id", "_lt", F.col("item").alias("_best"))


# ----------------------------------------------------------------------------- misc shapes

def full_join_coalesce(left: DataFrame, right: DataFrame, on: Sequence[str], coalesce_cols: Sequence[str] = ()) -> DataFrame:
    """``FULL OUTER JOIN … USING (on)`` with coalesced keys and coalesced extra columns.

    Columns present on both sides other than ``on`` and ``coalesce_cols`` are kept from the side
    named first (``left``) unless coalesced.
    """
    on = _names(on)
    l = left.alias("_fl")
    r = right.alias("_fr")
    joined = l.join(r, [F.col(f"_fl.{k}") == F.col(f"_fr.{k}") for k in on], "full")
    out = [F.coalesce(F.col(f"_fl.{k}"), F.col(f"_fr.{k}")).alias(k) for k in on]
    out += [F.coalesce(F.col(f"_fl.{c}"), F.col(f"_fr.{c}")).alias(c) for c in coalesce_cols]
    taken = set(on) | set(coalesce_cols)
    for c in left.columns:
        if c not in taken:
            out.append(F.col(f"_fl.{c}").alias(c))
            taken.add(c)
    for c in right.columns:
        if c not in taken:
            out.append(F.col(f"_fr.{c}").alias(c))
            taken.add(c)
    return joined.select(*out)


def hop(df: DataFrame, edges: DataFrame, nodes: DataFrame, src_col: str, edge_src: str, edge_dst: str,
        node_key: str) -> DataFrame:
    """``df JOIN (SELECT DISTINCT src, dst FROM edges) ON src JOIN nodes ON dst`` (one graph hop)."""
    j = join_distinct(df, edges, src_col, [edge_src, edge_dst], edge_src)
    return j.join(nodes, j[edge_dst] == nodes[node_key], "inner")


def explode_list(df: DataFrame, col: str, sep: str = ",", name: str | None = None, trim: bool = False) -> DataFrame:
    """``FROM t JOIN UNNEST(SPLIT(col, sep)) AS name``: one row per element, elements not trimmed.

    Null or missing lists produce no rows (the UNNEST of a null array is empty).
    """
    name = name or col
    parts = F.split(F.col(col), re.escape(sep), -1)
    out = df.withColumn(name, F.explode(parts))
    if trim:
        out = out.withColumn(name, F.trim(F.col(name)))
    return out



def join_back(df: DataFrame, picked: DataFrame, on) -> DataFrame:
    """R13 ``JOIN picked USING (on)``: fetch every row matching the picked key tuple (ties kept)."""
    return df.join(picked, _names(on), "inner")


def with_parent(df: DataFrame, blocks: DataFrame, *, id_col: str = "id_block", parent_col: str = "parent_id_block",
                how: str = "inner") -> DataFrame:
    """R14 child → parent lookup through the lineage table (``JOIN blocks ON blocks.id = df.id``)."""
    b = blocks.select(F.col(id_col).alias("_wp_id"), F.col(parent_col).alias(parent_col))
    return df.join(b, df[id_col] == b["_wp_id"], how).drop("_wp_id")
