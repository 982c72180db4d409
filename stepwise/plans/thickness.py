"""Thickness versus recipe target (J28), outlier classes (J28b) and chart-ready marks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwise.functions.nullops import safe_number, strict_least
from stepwise.functions.timeops import as_utc, between_instants, shift
from stepwise.operators.joins import full_join_coalesce, offset_join
from stepwise.operators.latest import first_per_key, top_row_per_key
from stepwise.operators.ordered import global_dense_rank

# Fixed values of the reference chart: limit and tolerance band (µm), the bar drawn inside the limit.
LIMIT = 80.0
TOLERANCE = 50.0
MARK_FRACTION = 0.9
ARROW_FRACTION = 0.5


def outlier_class(min_dev, max_dev, limit: float = LIMIT, ways: int = 5) -> Column:
    """``Both`` / ``AllMin`` / ``AllMax`` / ``Max`` / ``Min`` / null (5-way, order matters) or the
    older 3-way ``Both`` / ``Max`` / ``Min`` / null; comparisons are strict."""
    lo = F.col(min_dev) if isinstance(min_dev, str) else min_dev
    hi = F.col(max_dev) if isinstance(max_dev, str) else max_dev
    if ways == 5:
        return (F.when((hi > limit) & (lo < -limit), "Both").when(hi < -limit, "AllMin").when(lo > limit, "AllMax")
                .when(hi > limit, "Max").when(lo < -limit, "Min"))
    if ways == 3:
        return F.when((hi > limit) & (lo < -limit), "Both").when(hi > limit, "Max").when(lo < -limit, "Min")
    raise ValueError("ways must be 5 or 3")


def thickness_report(measurements: DataFrame, blocks: DataFrame, layers: DataFrame, recipes: DataFrame,
                     history: DataFrame, dims: DataFrame, as_of, *, collection: str, exclude_flow: str | None,
                     min_param: str, max_param: str, cohort_days: float = 90, recent_days: float = 7,
                     offset: timedelta = timedelta(minutes=10), terminate_op: str = "Terminate",
                     step_prefixes: Sequence[str] = ("304", "344", "704"), large_over: float = 25,
                     limit: float = LIMIT, rank_width: float = 100000, ways: int = 5,
                     text_params: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """Per measured or scrapped unit — parent, layer, first characterisation, min/max thickness
    against the parent's newest recipe target, size group, parent rank, scrap flag and outlier class.

    Stages: first characterisation per unit (``min``) → measurements before first + ``offset`` and
    within ``recent_days`` joined to unit, layer and the parent's newest recipe (argmax via
    ``max(struct)``, no window), min/max pivoted → scrapped units of those parents (first terminate
    time) → full outer join on (parent, unit) with coalesced layer → parent size with a null-strict
    ``LEAST`` → ``DENSE_RANK`` over (size group, parent) without a single-partition window.

    ``ways=3`` gives the older variant's outlier classes, ``text_params`` adds one text column per
    (name, parameter), such as the older variant's spread and range readings. Rows come in the order
    parent, layer, first characterisation unless ``ordered`` is off.
    """
    text_params = text_params or {}
    as_of = as_utc(as_of)
    first = measurements.filter((F.col("data_collection_name") == F.lit(collection))
                                & between_instants(measurements, "data_collection_complete_date", as_of - timedelta(days=cohort_days), None, False))
    if exclude_flow is not None:
        first = first.filter(F.col("flow_name") != F.lit(exclude_flow))
    first = first_per_key(first, ["sample_id"], "data_collection_complete_date", "_first")
    last_laser = top_row_per_key(recipes, ["id_block"], ["timestamp"], ["recipe_target"])
    dc = measurements.filter(between_instants(measurements, "data_collection_complete_date", as_of - timedelta(days=recent_days), None, False))
    fc = first.select(F.col("sample_id").alias("_fs"), "_first")
    j = offset_join(dc, fc, [("sample_id", "_fs")],
                    F.col("data_collection_complete_date") < shift(F.col("_first"), int(offset.total_seconds()), "SECOND"))
    j = j.join(blocks.select(F.col("id_block").alias("_bid"), "parent_id_block"), F.col("sample_id") == F.col("_bid"))
    j = j.filter(F.col("parent_id_block").isNotNull())
    j = j.join(layers.select(F.col("id_block").alias("_lid"), F.col("data").alias("layer")), F.col("sample_id") == F.col("_lid"))
    j = j.join(last_laser.select(F.col("id_block").alias("_rid"), "recipe_target"), F.col("parent_id_block") == F.col("_rid"))
    tgt = F.substring("recipe_target", 1, 3)
    raw = j.groupBy("parent_id_block", F.col("sample_id").alias("id_block"), "layer",
                    F.col("_first").alias("data_collection_complete_date"),
                    F.col("manufacturer_lot_number").alias("batch"), "product_name",
                    safe_number(tgt).alias("target_thick")).agg(
        F.max(tgt).alias("recipe_target"), F.max("flow_name").alias("flow"),
        F.max(F.when(F.col("parameter_name") == F.lit(min_param), safe_number("collected_value"))).alias("minThick_raw"),
        F.max(F.when(F.col("parameter_name") == F.lit(max_param), safe_number("collected_value"))).alias("maxThick_raw"),
        *[F.max(F.when(F.col("parameter_name") == F.lit(p), F.col("collected_value"))).alias(n) for n, p in text_params.items()])

    in_steps = F.lit(False)
    for prefix in step_prefixes:  # prefixes may differ in length
        in_steps = in_steps | F.col("step_name").startswith(prefix)
    sc = history.filter((F.col("operation_name") == F.lit(terminate_op))
                        & between_instants(history, "modified_on", as_of - timedelta(days=cohort_days), None, False)
                        & in_steps)
    sc = sc.join(blocks.select("id_block", "parent_id_block"), "id_block") \
        .join(layers.select("id_block", F.col("data").alias("layer")), "id_block")
    sc = sc.join(raw.select("parent_id_block").distinct(), "parent_id_block", "left_semi")
    scrapped = sc.groupBy("parent_id_block", "id_block", "layer").agg(F.min("modified_on").alias("time_terminated"))
    both = full_join_coalesce(raw, scrapped, ["parent_id_block", "id_block"], ["layer"])
    both = both.select("parent_id_block", "id_block", "layer", "data_collection_complete_date", "time_terminated",
                       "batch", "product_name", "minThick_raw", "maxThick_raw", "target_thick", "recipe_target",
                       (F.col("minThick_raw") - F.col("target_thick")).alias("minThick"),
                       (F.col("maxThick_raw") - F.col("target_thick")).alias("maxThick"), *text_params)
    pbd = dims.select(F.col("id_block").alias("_pid"), strict_least("width", "length").alias("parent_size"))
    binned = both.join(pbd, both["parent_id_block"] == pbd["_pid"]).drop("_pid")
    binned = binned.withColumn("size_group", F.when(F.col("parent_size") > large_over, "large").otherwise("small"))
    ranked = global_dense_rank(binned, ["size_group", "parent_id_block"], width=rank_width, name="parent_rank",
                               bucket_col="parent_id_block")
    out = ranked.withColumn("Terminated", F.when(F.col("time_terminated").isNotNull(), 1).otherwise(0)) \
        .withColumn("outlier_type", outlier_class("minThick", "maxThick", limit, ways))
    return out.orderBy("parent_id_block", "layer", "data_collection_complete_date") if ordered else out


def facet_order(df: DataFrame, col: str = "layer", name: str = "facet") -> DataFrame:
    """Distinct values sorted, the last moved to the front (``l.sort(); l.insert(0, l.pop())``),
    as a 0-based facet index. Runs on the distinct values only (a handful of layers)."""
    vals = df.select(col).filter(F.col(col).isNotNull()).distinct()
    n = vals.select(F.count(F.lit(1))).scalar()
    r = vals.withColumn("_r", F.row_number().over(Window.orderBy(F.col(col).asc())))
    return r.select(col, F.when(F.col("_r") == n, F.lit(0)).otherwise(F.col("_r")).alias(name))


def chart_marks(report: DataFrame, *, limit: float = LIMIT, tolerance: float = TOLERANCE,
                materialize: bool = True) -> DataFrame:
    """The chart as tidy marks — one row per drawn element — instead of a rendered figure.

    Per report row: a ``bar`` from min to max deviation at x = parent rank; red ``upper`` /
    ``lower`` marks for Max/Min/Both; ``arrow_down`` / ``arrow_up`` for AllMin / AllMax; a ``scrap``
    marker at 0. Per facet (layer, ordered with the last layer first): the ``spec`` line at 0 and
    the ``band`` lines at ±tolerance across x-range min−0.5 .. max+0.5.

    The report is read three times (facets, x-range, marks), so it is materialised once with a
    reliable ``checkpoint()`` into the session's checkpoint folder (``materialize=False`` skips it).
    """
    if materialize:
        from stepwise.session import checkpoint_dir
        checkpoint_dir(report.sparkSession)
        report = report.checkpoint(eager=True)
    facets = facet_order(report, "layer", "facet")
    rows = report.filter(F.col("layer").isNotNull()).join(facets, "layer")
    x = F.col("parent_rank").cast("double")
    o = F.col("outlier_type")

    def mark(kind: str, cond: Column | None, y0, y1) -> Column:
        s = F.struct(F.lit(kind).alias("mark"), x.alias("x0"), x.alias("x1"),
                     F.lit(y0).cast("double").alias("y0") if not isinstance(y0, Column) else y0.cast("double").alias("y0"),
                     F.lit(y1).cast("double").alias("y1") if not isinstance(y1, Column) else y1.cast("double").alias("y1"))
        return s if cond is None else F.when(cond, s)

    marks = F.array(
        mark("bar", None, F.col("minThick"), F.col("maxThick")),
        mark("upper", o.isin("Both", "Max"), MARK_FRACTION * limit, limit),
        mark("lower", o.isin("Both", "Min"), -limit, -MARK_FRACTION * limit),
        mark("arrow_down", o == "AllMin", ARROW_FRACTION * limit, -limit),
        mark("arrow_up", o == "AllMax", -ARROW_FRACTION * limit, limit),
        mark("scrap", F.col("Terminated") == 1, 0.0, 0.0),
    )
    per_row = rows.select("layer", "facet", "parent_id_block", "id_block",
                          F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    per_row = per_row.select("layer", "facet", "parent_id_block", "id_block", "m.*")
    xr = report.select(F.struct(F.min("parent_rank").alias("lo"), F.max("parent_rank").alias("hi"))).scalar()
    lo = xr.getField("lo").cast("double") - F.lit(0.5)
    hi = xr.getField("hi").cast("double") + F.lit(0.5)
    lines = F.array(
        F.struct(F.lit("spec").alias("mark"), F.lit(0.0).alias("y")),
        F.struct(F.lit("band").alias("mark"), F.lit(float(tolerance)).alias("y")),
        F.struct(F.lit("band").alias("mark"), F.lit(-float(tolerance)).alias("y")),
    )
    per_facet = facets.select("layer", "facet", F.explode(lines).alias("l")).select(
        "layer", "facet", F.lit(None).cast("bigint").alias("parent_id_block"), F.lit(None).cast("bigint").alias("id_block"),
        F.col("l.mark").alias("mark"), lo.alias("x0"), hi.alias("x1"), F.col("l.y").alias("y0"), F.col("l.y").alias("y1"))
    return per_row.unionByName(per_facet)
