"""Run-level jobs: end-time verification, equipment configuration, measurement searches, missing
metrics, flag review, event classification, label audit and recipe-change impact
(J06 J07 J08 J09 J11 J12 J13 J19)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from stepwise.functions.nullops import safe_number
from stepwise.functions.rules import Alias, canonicalise, classify
from stepwise.functions.timeops import (
    DEFAULT_TZ, as_utc, between_instants, hours_between, in_local_dates, local_date, shift, sunday_week,
)
from stepwise.operators.dyadic import exact_code
from stepwise.operators.joins import hop, in_ids, latest_before
from stepwise.operators.lists import grouped_sorted_list
from stepwise.operators.ordered import delta_from_prev, hot_keys
from stepwise.operators.pivot import pivot_params
from stepwise.operators.ranges import range_totals
from stepwise.sources.sinks import only_new


# ----------------------------------------------------------------------------- J06

def last_reading_per_run(runs: DataFrame, stations: DataFrame, sensor: DataFrame, done: DataFrame, as_of, *,
                         window: timedelta = timedelta(hours=24 * 30), before: timedelta = timedelta(hours=2),
                         after: timedelta = timedelta(hours=1), shard_col: str = "data_table") -> DataFrame:
    """For runs ended in ``(as_of - window) .. as_of`` with positive duration and not yet in
    ``done``: the newest sensor timestamp in ``[end - before, end + after)`` on the station's shard,
    same growing run, non-empty sensor id and matching text run id. Runs without readings give no row.

    One set-based plan instead of one query per run: the shard column joins (dynamic partition
    pruning on a sharded sensor dataset), the implied time range is pushed to the sensor scan, and
    ``max`` is partially aggregated before the shuffle.
    """
    as_of = as_utc(as_of)
    lo, hi = as_of - window, as_of
    r = runs.filter(between_instants(runs, "end_time", lo, hi) & (F.col("run_duration") > 0))
    r = only_new(r, done, "id_run_growth")
    r = r.join(stations.select("id_station", shard_col), "id_station")
    r = r.select("id_run_growth", "id_growing_run", "end_time", F.col(shard_col).alias("_shard"))
    s = sensor.filter(between_instants(sensor, "timestamp", lo - before, hi + after, True, False))
    s = s.filter(F.col("pyrometer.id_value") != F.lit(""))
    s = s.select(F.col(shard_col).alias("_sshard"), "timestamp", "id_run",
                 F.col("pyrometer.id_run_growth").alias("_grow"))
    cond = [s["_sshard"] == r["_shard"], s["id_run"] == r["id_growing_run"],
            s["_grow"] == r["id_run_growth"].cast("string"),
            s["timestamp"] >= shift(r["end_time"], -int(before.total_seconds())),
            s["timestamp"] < shift(r["end_time"], int(after.total_seconds()))]
    j = r.join(s, cond, "inner")
    return j.groupBy("id_run_growth", "id_growing_run", "end_time").agg(F.max("timestamp").alias("id_run_end_time"))


# ----------------------------------------------------------------------------- J07

def config_at_run(runs: DataFrame, config: DataFrame, columns: Sequence[tuple[str, Sequence[str] | str]], *,
                  aliases: Sequence[Alias] = (), width=1_000_000, materialize: bool = False) -> DataFrame:
    """Equipment configuration in force at each growing run.

    Parameter names are canonicalised; per run × (step name, parameter) the latest earlier config
    run on the station (``id_run < id_growing_run`` and ``start_time <`` run start) is found with the
    exact, skew-safe ``latest_before``; its rows are joined back on (run id, parameter) and pivoted to
    one column per parameter (``MAX(IF(param = …, step_data, NULL))``). Runs without any earlier
    configuration produce no row (the warehouse query's inner join back). ``width`` buckets run ids.
    """
    rdh = config.withColumn("step_parameter", canonicalise("step_parameter", aliases)) if aliases else config
    left = runs.select("id_run_growth", "id_growing_run", "station_name", "id_station", "start_time")
    right = rdh.select("id_station", "step_name", "step_parameter", "id_run", "start_time")
    last = latest_before(left, right, by=["id_station"], combos=["step_name", "step_parameter"],
                         left_id="id_growing_run", right_id="id_run", left_time="start_time",
                         right_time="start_time", width=width, name="last_equipment_run",
                         materialize=materialize)
    last = last.filter(F.col("last_equipment_run").isNotNull())
    last = last.groupBy("id_growing_run", "id_run_growth", "station_name", "step_name", "step_parameter") \
        .agg(F.max("last_equipment_run").alias("last_equipment_run"))
    vals = rdh.select(F.col("id_run").alias("last_equipment_run"), "step_parameter", "step_data")
    j = last.drop("step_name").join(vals, ["last_equipment_run", "step_parameter"], "inner")
    return pivot_params(j, ["id_run_growth", "id_growing_run", "station_name"], "step_parameter", "step_data", columns)


# ----------------------------------------------------------------------------- J08

def measure_over(history: DataFrame, processes: Sequence[str], parameter: str, min_value: float, as_of, *,
                 days: float = 30) -> DataFrame:
    """Measurements above ``min_value`` (text parsed safely) in the last ``days`` per unit ×
    process, with *independent* maxima of time, run and text value (text ``max`` is lexicographic)."""
    since = as_utc(as_of) - timedelta(days=days)
    h = history.filter(F.col("process_name").isin(list(processes)) & (F.col("step_parameter") == F.lit(parameter))
                       & (safe_number("data") > F.lit(min_value))
                       & between_instants(history, "timestamp", since, None, False))
    return h.groupBy("id_block", "process_name").agg(F.max("timestamp").alias("timestamp"),
                                                     F.max("id_run").alias("id_run"), F.max("data").alias("data"))


# ----------------------------------------------------------------------------- J09

def runs_missing_metric(blocks: DataFrame, runs: DataFrame, classes: Sequence[tuple[Column, str]], as_of, *,
                        days: int = 30, before_date: str | None = None, location: str | None = None,
                        tz: str = DEFAULT_TZ) -> DataFrame:
    """Classified runs in the last ``days`` local dates whose derived volume is missing;
    per run and location the number and sorted list of unit ids."""
    r = runs.filter(in_local_dates(runs, "end_time", as_of, days, tz))
    j = blocks.join(r, "id_run_growth", "inner")
    j = j.select("id_run_growth", "growing_location_name", "id_block",
                 classify(classes).alias("run_type"), local_date("end_time", tz).alias("end_date"),
                 ((F.col("new_thickness") - F.col("pre_thickness")) * F.col("abs_clean_area_rect_210")).alias("final_clean_vol_cm3"))
    keep = F.col("run_type").isNotNull() & F.col("final_clean_vol_cm3").isNull()
    if before_date:
        keep = keep & (F.col("end_date") < F.lit(before_date).cast("date"))
    if location is not None:
        keep = keep & (F.col("growing_location_name") == F.lit(location))
    return grouped_sorted_list(j.filter(keep), ["id_run_growth", "growing_location_name"], "id_block", "block_ids",
                               count_name="block_count").select("id_run_growth", "growing_location_name",
                                                                "block_count", "block_ids")


# ----------------------------------------------------------------------------- J11

def flag_review(summary: DataFrame, runs: DataFrame, flags: DataFrame, events: DataFrame, ids, reviewed, as_of, *,
                days: float = 90, purpose: str = "Production", flag_value: str = "No Excursions") -> DataFrame:
    """Runs from an id list (minus reviewed ids) with positive block count but flag ``flag_value``;
    one row per run event with hours from run start; newest run first."""
    since = as_utc(as_of) - timedelta(days=days)
    r = runs.filter(between_instants(runs, "end_time", since, None, False)) \
        .filter(F.col("loading_purpose") == F.lit(purpose))
    j = summary.join(r, "id_run_growth", "inner")
    j = in_ids(j, "id_run_growth", ids)
    j = in_ids(j, "id_run_growth", reviewed, negate=True)
    j = j.filter(F.col("char_block_count_240") > 0)
    j = j.join(flags, "id_run_growth", "left").filter(F.col("excursion_types") == F.lit(flag_value))
    ev = events.select("id_run_growth", F.col("timestamp").alias("_ev_ts"))
    j = j.join(ev, "id_run_growth", "left")
    out = j.select("id_run_growth", "end_time", "char_block_count_240", "excursion_types", "run_duration",
                   hours_between("_ev_ts", "start_time").alias("hour_since_start"))
    return out.orderBy(F.col("end_time").desc(), F.col("hour_since_start").desc())


# ----------------------------------------------------------------------------- J12

def classify_events(events: DataFrame, runs: DataFrame, rules: Sequence[tuple[Column, str]], default: str,
                    keep: Column, *, min_hours_from_start: float = 24, min_hours_to_end: float = 0.5) -> DataFrame:
    """Events joined to runs by a safely cast key; hours since start / to end (whole seconds);
    ``keep`` thresholds plus distance from both run ends; priority ``rules`` label; Sunday week."""
    tri = runs.select(F.col("id_run_growth").alias("_rid"), F.unix_seconds(F.col("start_time").cast("timestamp")).alias("_s"),
                      F.unix_seconds(F.col("end_time").cast("timestamp")).alias("_e"), F.col("end_time").alias("_end"),
                      F.col("loading_purpose").alias("_purpose"))
    ge = events.withColumn("_k", safe_number("id_run_growth", "bigint"))
    j = ge.join(tri, ge["_k"] == tri["_rid"], "inner")
    t = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    j = j.filter(keep & ((t - F.col("_s")) > F.lit(min_hours_from_start * 3600))
                 & ((F.col("_e") - t) > F.lit(min_hours_to_end * 3600)))
    return j.select(F.col("_rid").alias("id_run_growth"), F.col("_end").alias("end_time"),
                    ((t - F.col("_s")) / 3600).alias("hour_since_start"), ((F.col("_e") - t) / 3600).alias("hour_til_end"),
                    sunday_week("timestamp").alias("time_trunc"), F.col("_purpose").alias("loading_purpose"),
                    classify(rules, default).alias("event_type"))


# ----------------------------------------------------------------------------- J13

def label_audit(units: DataFrame, dims: DataFrame, growth_blocks: DataFrame, run_events: DataFrame, trays,
                reasons: Sequence[tuple[Column, str]], *, exclude_tray_like: str | None = "%PS%",
                labels: tuple[str, str] = ("Striated", "Good")) -> DataFrame:
    """Label × first-matching-reason counts.

    Run events are collapsed to one row per run and end time *before* the join (``max`` of purpose
    and hours to end); units in the given trays are joined to their dimensions and growth row and
    left-joined to the collapsed events. A unit is labelled by whether an event exists.
    ``reasons`` may use ``end_time``, ``hour_til_end``, ``final_clean_vol_cm3``, ``loading_purpose``,
    ``custom_workflow``.
    """
    gwt = run_events.groupBy("id_run_growth", "end_time").agg(F.max("loading_purpose").alias("loading_purpose"),
                                                              F.max("hour_til_end").alias("hour_til_end"))
    u = in_ids(units, "id_tray", trays)
    if exclude_tray_like:
        u = u.filter(~F.col("tray_name").like(exclude_tray_like))
    d = dims.select("id_block", "latest_id_run_growth", "post_hep_bake_weight", "custom_workflow")
    b = growth_blocks.select(F.col("id_block").alias("_bid"), F.col("id_run_growth").alias("_brun"), "final_clean_vol_cm3")
    j = u.select("id_block").join(d, "id_block")
    j = j.join(b, (j["latest_id_run_growth"] == b["_brun"]) & (j["id_block"] == b["_bid"]), "inner")
    j = j.join(gwt, j["latest_id_run_growth"] == gwt["id_run_growth"], "left")
    lab = F.when(F.col("hour_til_end").isNotNull(), F.lit(labels[0])).otherwise(F.lit(labels[1]))
    out = j.select(lab.alias("theoretical_label"), classify(reasons).alias("mistake"))
    return out.groupBy("theoretical_label", "mistake").agg(F.count(F.lit(1)).alias("count")).orderBy("theoretical_label", "mistake")


# ----------------------------------------------------------------------------- J19

def _time_code(df: DataFrame, col: str) -> Column:
    """The column's times as integers: microseconds, or the numbers themselves where times are whole numbers."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.unix_micros(c.cast("timestamp"))
    code = exact_code(df, col)
    if code is None:
        raise TypeError(f"no times in {kind.simpleString()} column {col}")
    return code


def change_impact(changes: DataFrame, edges: DataFrame, stations: DataFrame, runs: DataFrame, *,
                  process=None, station_name: str | None = None, since=None, run_ids=None,
                  id_width=1_000_000, time_width=86400) -> DataFrame:
    """Recipe changes propagated to the runs they touched.

    Previous value per station × parameter by run id (skew-safe ``LAG``) is computed over the whole
    process history *before* any station/date filter (the filter stays above the window). Changes
    follow distinct station edges to target stations and meet runs active at the change time
    (``operators.ranges``): a run of any length takes a running total at its start, one at its end and a few totals of
    the time between, each one row with all its parameters. So the rows that are shuffled grow with changes plus runs, and
    nothing but the lists' lengths with their product. ``time_width`` is the size of a day in seconds; a station's
    changes and run ends of about one day are sorted together.
    Per run: total change, sorted list and count of changed parameters.
    """
    gc = changes if process is None else changes.filter(F.col("id_process") == F.lit(process))
    gc = gc.filter(F.col("id_station").isNotNull()).select(
        safe_number("step_data").alias("step_data"), "start_time", "id_run", "id_station", "step_parameter",
        *["station_name"] * (station_name is not None))
    st = stations.select(F.col("id_station").alias("_tid"))

    def reached(df: DataFrame) -> DataFrame:
        if station_name is not None:
            df = df.filter(F.col("station_name") == F.lit(station_name))
        if since is not None:
            df = df.filter(between_instants(df, "start_time", as_utc(since), None, False))
        if run_ids is not None:
            df = in_ids(df, "id_run", run_ids)
        # filtered here, so that both reads of the points need the same rows and share one exchange
        j = hop(df, edges, st, "id_station", "source_id_station", "target_id_station", "_tid").filter(F.col("start_time").isNotNull())
        return j.select(F.col("target_id_station").alias("key"), _time_code(changes, "start_time").alias("code"),
                        F.col("step_parameter").alias("item"), F.col("change_of_value").alias("value"))

    # an ordinary station's rows lie in one partition, which serves the LAG and the hop; only a station that holds many of the
    # rows is spread for its LAG and shuffled again for the hop
    hot = hot_keys(gc, ["id_station"], ["id_run"])
    own = Window.partitionBy("id_station", "step_parameter").orderBy(F.col("id_run").asc_nulls_first(), F.col("step_data").asc_nulls_first())
    few = gc.filter(~hot).repartition("id_station").withColumn("change_of_value", F.col("step_data") - F.lag("step_data", 1).over(own))
    many = delta_from_prev(gc.filter(hot), "step_data", ["id_station", "step_parameter"], ["id_run"], width=id_width, name="change_of_value")
    points = reached(few).unionByName(reached(many))
    times = isinstance(changes.schema["start_time"].dataType, (TimestampType, TimestampNTZType, DateType))
    ranges = runs.select(F.col("id_station").alias("key"), _time_code(runs, "start_time").alias("lo"), _time_code(runs, "end_time").alias("hi"),
                         "mean_growth_rate", "id_run_growth")
    top = (max(1, int(time_width * (1_000_000 if times else 1))) - 1).bit_length()
    found = range_totals(points, ranges, top)
    # a run's rows lie in one partition from here on: its totals are added and its list is made without another exchange
    keys = ["id_run_growth", "mean_growth_rate"]
    found = found.repartition(F.xxhash64(*keys)).withColumn("_run", F.xxhash64(*keys))
    found = found.select("_run", *keys, "total", F.posexplode(F.arrays_zip("items", "counts")).alias("_at", "_of"))
    found = found.select("_run", *keys, F.col("_of.items").alias("step_parameter"), F.col("_of.counts").alias("_n"),
                         F.when(F.col("_at") == 0, F.col("total")).alias("change_of_value"))
    out = grouped_sorted_list(found, ["_run", *keys], "step_parameter", "changed_parameters",
                              count_name="changed_parameter_count", sums={"change_of_n2": "change_of_value"}, weight="_n")
    return out.select(*keys, "change_of_n2", "changed_parameters", "changed_parameter_count")
