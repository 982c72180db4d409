"""Period reports: throughput (J24) and cycle time.

Both scan their facts once: each row is tagged with every look-back period it falls in
(``explode_periods``) and aggregated by period, instead of one scan per period joined by UNION.
Report grids are literal axes exploded onto small inline dimensions (no cross join), and the
results are left-joined onto the grid so empty cells get the report's default.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.nullops import nonzero_or
from stepwise.functions.text import split_first
from stepwise.functions.timeops import (
    DEFAULT_TZ, as_utc, between_instants, in_local_dates, instant_of_local_date, local_day_floor,
    local_day_start, local_midnight_of, local_today, ts_literal,
)
from stepwise.operators.grids import Period, explode_periods, ordered_dim, rank_by_first, report_grid, union_sources
from stepwise.operators.joins import anti_null_aware

PRODUCT_WEIGHTS = (("1x1", 1), ("2x2", 4), ("D200", 36))
# (label, local-day look-back of the period filter or None for the whole window, divisor)
THROUGHPUT_PERIODS = (("14d", None, 14), ("5d", 6, 5), ("1d", 1, 1))
CYCLE_PERIODS = (("90d", 90), ("30d", 30), ("7d", 7))


def _log_filters(log: DataFrame, flow, flow_col, exclude_material, exclude_ids, id_col="id_block") -> DataFrame:
    out = log
    if flow is not None:
        out = out.filter(F.col(flow_col) == F.lit(flow))
    if exclude_material is not None:
        out = out.filter(F.col("material_type_in") != F.lit(exclude_material))
    if exclude_ids is not None:
        from stepwise.operators.joins import key_frame
        out = anti_null_aware(out, key_frame(out.sparkSession, exclude_ids, "_x"), id_col, "_x")
    return out


def throughput_report(log: DataFrame, transitions: DataFrame, shipments: DataFrame, dims: DataFrame, stock: DataFrame,
                      grown_blocks: DataFrame, grown_runs: DataFrame, as_of, *, flow: str | None = None,
                      flow_col: str = "flow_name_in", exclude_ids=None, exclude_material: str | None = "Software Test",
                      exclude_segment: str = "Finish", ship_size: str = "1x1", ship_segment: str = "Finish",
                      parent_segment: str = "Singulation|parent", block_divisor: float = 460,
                      products: Sequence[tuple[str, float]] = PRODUCT_WEIGHTS,
                      periods: Sequence[tuple[str, int | None, float]] = THROUGHPUT_PERIODS, default: float = 0.01,
                      stock_label: str = "Stock/30", stock_order: int = 8, stock_period: str = "5d",
                      stock_divisor: float = 30, grown_label: str = "Grown", grown_order: int = 1,
                      grown_exclude_seed: str = "Others", keep_period: str | None = None,
                      keep_product: str | None = None, tz: str = DEFAULT_TZ) -> DataFrame:
    """Units out of each segment per day over several look-backs, on a full report grid.

    * transitions are ordered by ``DENSE_RANK(step) + 1``; log rows match a transition on both codes;
    * the window is local midnight 15 days back .. today's local midnight (``interval 14+1 day``);
    * blocks count ``floor((thickness or 460 when 0/null) / 460)`` plates, plates count 1;
    * the 14d total is divided by 14; 5d and 1d keep rows whose local day is between the local day
      of ``as_of - 6`` / ``- 1`` days and ``as_of``'s *UTC* wall clock (as the report did), / 5 and / 1;
    * a stock row (sum / 30) and grown rows (per seed type, exact local dates) are added;
    * the label before ``|`` names the output segment, products are weighted, empty cells give 0.01.
    """
    as_of = as_utc(as_of)
    numbered = ordered_dim(transitions, "step_name", 2, "step_order")
    lo, hi = local_midnight_of(as_of, tz, 15), local_midnight_of(as_of, tz, 0)
    mh = _log_filters(log, flow, flow_col, exclude_material, exclude_ids)
    mh = mh.filter(between_instants(log, "end_time", lo, hi) & F.col("end_time").isNotNull())
    mh = mh.join(numbered.select("step_name", "step_name_next", "segment_name", "unit"),
                 ["step_name", "step_name_next"]).filter(F.col("segment_name") != F.lit(exclude_segment))
    th = dims.select(F.col("id_block").alias("_bid"), "thickness")
    logged = mh.join(th, mh["id_block"] == th["_bid"], "left").select("unit", "end_time", "segment_name", "thickness", "id_block")
    ships = shipments.filter(between_instants(shipments, "timestamp", lo, hi) & (F.col("size_family") == F.lit(ship_size)))
    ships = ships.join(dims.select("id_block", "thickness"), "id_block").select(
        F.lit("Plate").alias("unit"), F.col("timestamp").alias("end_time"), F.lit(ship_segment).alias("segment_name"),
        "thickness", "id_block")
    raw = union_sources(logged, ships).withColumn("master_product", F.lit(products[0][0]))
    raw = raw.filter(between_instants(raw, "end_time", lo, as_of))
    raw = raw.withColumn("end_date_PST", local_day_start("end_time", tz))
    raw = raw.withColumn("plate_count", F.when(F.col("unit") == "Block",
                                               F.floor(nonzero_or("thickness", block_divisor) / block_divisor))
                         .otherwise(F.lit(1)))
    now_wall = ts_literal(as_of)  # CURRENT_DATETIME(): UTC wall clock
    membership = []
    for i, (label, lookback, divisor) in enumerate(periods):
        p = Period(label, i, divisor)
        if lookback is None:
            membership.append((p, F.lit(True)))
        else:
            floor_ = ts_literal(local_day_floor(as_of, tz, lookback))
            membership.append((p, (F.col("end_date_PST") >= floor_) & (F.col("end_date_PST") <= now_wall)))
    tagged = explode_periods(raw, membership)
    d = tagged.groupBy("segment_name", "master_product", "period").agg(
        (F.sum("plate_count") / F.max("_divisor")).alias("output"))
    segs = numbered.select("segment_name", "step_order").distinct()
    grid = report_grid(segs, col=[p[0] for p in periods], master_product=[p for p, _ in products])
    cells = grid.join(d.withColumnRenamed("period", "col"), ["segment_name", "master_product", "col"], "left") \
        .select("segment_name", "step_order", "col", "master_product", "output")
    stock_row = stock.agg((F.sum("plate_count") / F.lit(float(stock_divisor))).alias("output")).select(
        F.lit(stock_label).alias("segment_name"), F.lit(stock_order).alias("step_order"), F.lit(stock_period).alias("col"),
        F.lit(products[0][0]).alias("master_product"), "output")
    grown = _grown(grown_blocks, grown_runs, as_of, periods, products, tz, grown_exclude_seed, block_divisor)
    grown = grown.select(F.lit(grown_label).alias("segment_name"), F.lit(grown_order).alias("step_order"),
                         "col", "master_product", "output")
    allrows = union_sources(cells, stock_row.select(cells.columns), grown.select(cells.columns))
    allrows = allrows.filter(F.col("segment_name") != F.lit(parent_segment))
    if keep_period is not None:
        allrows = allrows.filter(F.col("col") == F.lit(keep_period))
    if keep_product is not None:
        allrows = allrows.filter(F.col("master_product") == F.lit(keep_product))
    weighted = None
    for name, w in products:
        cond = F.col("master_product") == F.lit(name)
        val = F.col("output") * F.lit(w) if w != 1 else F.col("output")
        weighted = F.when(cond, val) if weighted is None else weighted.when(cond, val)
    weighted = weighted.otherwise(F.col("output"))
    out = allrows.groupBy(split_first("segment_name", "|").alias("segment"), "step_order",
                          F.col("col").alias("period"), "master_product").agg(
        F.coalesce(F.sum(weighted), F.lit(default)).alias("yield"))
    return out.select("segment", "step_order", "period", "yield", "master_product") \
        .orderBy("step_order", "period", "master_product")


def _grown(blocks: DataFrame, runs: DataFrame, as_of, periods, products, tz, exclude_seed, divisor) -> DataFrame:
    longest = int(max(p[2] for p in periods))
    b = blocks.filter(in_local_dates(blocks, "end_time", as_of, longest, tz))
    j = b.join(runs.select("id_run_growth", "seed_size_type"), "id_run_growth") \
        .filter(F.col("seed_size_type") != F.lit(exclude_seed))
    j = j.select(F.col("seed_size_type").alias("seed_type"), "end_time",
                 F.greatest(F.coalesce(F.floor(F.col("new_thickness") / divisor - 2), F.lit(0)), F.lit(1)).alias("plate_count"))
    today = local_today(as_of, tz)
    membership = []
    for i, (label, _, divisor) in enumerate(periods):
        lo = instant_of_local_date(today - timedelta(days=int(divisor)), tz)
        membership.append((Period(label, i, divisor), between_instants(j, "end_time", lo, None)))
    tagged = explode_periods(j, membership)
    y = tagged.groupBy("period", "seed_type").agg((F.sum("plate_count") / F.max("_divisor")).alias("output"))
    grid = report_grid(blocks.sparkSession.range(1).select(), col=[p[0] for p in periods],
                       master_product=[p for p, _ in products])
    return grid.join(y, (grid["col"] == y["period"]) & (grid["master_product"] == y["seed_type"]), "left") \
        .select("col", "master_product", "output")


def cycle_time_report(log: DataFrame, transitions: DataFrame, segment_steps: DataFrame, blocks: DataFrame, as_of, *,
                      flow: str | None = None, flow_col: str = "flow_name_in", exclude_ids=None,
                      exclude_material: str | None = "Software Test", parent_segment: str = "Singulation|parent",
                      periods: Sequence[tuple[str, int]] = CYCLE_PERIODS, cohort_days: int = 90, log_days: int = 365,
                      default: float = 0.01, tz: str = DEFAULT_TZ) -> DataFrame:
    """Average / max / count of cycle hours per segment for several cohort look-backs.

    Cohort: newest finish per unit × segment over matching transitions (90 local days, exclusive
    bounds). Step rows of those units count towards a segment when the step belongs to it;
    hours are summed per unit × segment. Children inherit all of their parent's segment hours,
    while the parent keeps its own rows except ``parent_segment``; names are cut before ``|``.
    Segments are ranked by first position, periods by their order; empty cells give 0.01 for
    average and max, and a null count.
    """
    as_of = as_utc(as_of)
    lo, hi = local_midnight_of(as_of, tz, cohort_days), local_midnight_of(as_of, tz, 0)
    base = _log_filters(log, flow, flow_col, None, None)
    cohort_src = base if exclude_ids is None else _log_filters(base, None, flow_col, None, exclude_ids)
    cohort_src = cohort_src.filter(between_instants(log, "end_time", lo, hi, False, False))
    bts = cohort_src.join(transitions.select("step_name", "step_name_next", "segment_name"),
                          ["step_name", "step_name_next"]) \
        .groupBy("id_block", "segment_name").agg(F.max("end_time").alias("segment_finish_time"))
    since = as_of - timedelta(days=log_days)
    mh = _log_filters(log, flow, flow_col, exclude_material, None)
    mh = mh.filter(between_instants(log, "end_time", since, None, False)
                   & F.col("step_name_next").isNotNull() & F.col("cycle_time").isNotNull())
    mh = mh.select("id_block", "step_name", (F.col("cycle_time") / 3600).alias("cycle_hour"))
    rr = mh.join(bts, "id_block").join(segment_steps.select("step_name", "segment_name"),
                                       ["step_name", "segment_name"])
    ctpb = rr.groupBy("id_block", "segment_name", "segment_finish_time").agg(F.sum("cycle_hour").alias("cycle_hour"))
    # one pass over the hours: a parent meets its children and itself, a unit without children nobody
    edges = blocks.select(F.col("id_block").alias("_child"), F.col("parent_id_block").alias("_parent"), F.lit(False).alias("_own"))
    parents = blocks.select("parent_id_block").filter(F.col("parent_id_block").isNotNull()).distinct()
    edges = edges.unionByName(parents.select(F.col("parent_id_block").alias("_child"), F.col("parent_id_block").alias("_parent"),
                                             F.lit(True).alias("_own")))
    met = ctpb.join(edges, ctpb["id_block"] == edges["_parent"], "left").filter(
        ~F.coalesce("_own", F.lit(True)) | (F.col("segment_name") != F.lit(parent_segment)))
    unit = F.when(F.col("_own").isNull(), F.col("id_block")).otherwise(F.col("_child"))
    conv = met.groupBy(unit.alias("id_block"), split_first("segment_name", "|").alias("segment_name")).agg(
        F.max("segment_finish_time").alias("segment_finish_time"), F.sum("cycle_hour").alias("cycle_hour"))
    membership = [(Period(label, i, 1), between_instants(conv, "segment_finish_time", local_midnight_of(as_of, tz, d), None, False))
                  for i, (label, d) in enumerate(periods)]
    tagged = explode_periods(conv, membership, name="time_interval")
    t = tagged.groupBy("segment_name", "time_interval").agg(
        F.avg("cycle_hour").alias("cycle_hour_avg"), F.max("cycle_hour").alias("cycle_hour_max"),
        F.count("id_block").alias("number_of_blocks"))
    segs = rank_by_first(segment_steps, split_first("segment_name", "|"), "pos", "segment_rank") \
        .withColumnRenamed("_key", "segment_name")
    pr = F.explode(F.array(*[F.struct(F.lit(label).alias("period"), F.lit(i).alias("period_rank"))
                             for i, (label, _) in enumerate(periods)]))
    grid = segs.withColumn("_p", pr).select("segment_name", "segment_rank", "_p.period", "_p.period_rank")
    j = grid.join(t, (grid["segment_name"] == t["segment_name"]) & (grid["period"] == t["time_interval"]), "left")
    out = j.select(grid["segment_name"], "segment_rank", "period", "period_rank",
                   F.coalesce("cycle_hour_avg", F.lit(default)).alias("cycle_hour_avg"),
                   F.coalesce("cycle_hour_max", F.lit(default)).alias("cycle_hour_max"), "number_of_blocks").distinct()
    return out.orderBy("period_rank", "segment_rank")
