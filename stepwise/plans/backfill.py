"""Latest-measurement backfills and fill-null merges (J20 J21), yield per parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.functions.nullops import safe_number
from stepwise.operators.joins import in_ids, join_back
from stepwise.operators.latest import latest_per_key
from stepwise.sources.sinks import merge_update, replace_keys
from stepwise.sources.versions import merge_rows, replace_rows

HISTORY_COLUMNS = ["id_block", "id_block_run", "id_run", "timestamp", "process_name", "step_name", "step_parameter", "data"]


def latest_measurements(history: DataFrame, run_blocks: DataFrame, ids, processes: Sequence[str], *,
                        exclude_location: str | None = None, with_growth: bool = True) -> DataFrame:
    """Rows of the newest run per listed unit × parameter, tagged with the unit's newest growth id.

    The newest growth per unit comes from ``run_blocks``; the run is chosen among rows with a
    parameter, an allowed process and a location other than ``exclude_location`` — but *all*
    history rows of the chosen run are returned (the filter steers the choice only). Ties on the
    run id keep every row. Units without a growth row are not returned.
    """
    btf = in_ids(run_blocks, "id_block", ids).groupBy("id_block").agg(F.max("id_run_growth").alias("id_run_growth"))
    chooser = history.filter(F.col("step_parameter").isNotNull() & F.col("process_name").isin(list(processes)))
    if exclude_location is not None:
        chooser = chooser.filter(F.col("location_name") != F.lit(exclude_location))
    last_runs = chooser.join(btf, "id_block").groupBy("id_run_growth", "id_block", "step_parameter") \
        .agg(F.max("id_run").alias("id_run"))
    rows = join_back(history, last_runs, ["id_block", "step_parameter", "id_run"])
    cols = [F.col(c) for c in HISTORY_COLUMNS]
    if with_growth:
        cols.append(F.col("id_run_growth").alias("last_growth"))
    return rows.select(*cols)


def backfill_latest(target: DataFrame, history: DataFrame, run_blocks: DataFrame, ids, processes: Sequence[str], *,
                    exclude_location: str | None = None, with_growth: bool = True) -> DataFrame:
    """The target's new content — rows of the listed units deleted (null keys kept), then the
    latest measurements of those units appended; one write instead of delete + insert."""
    new_rows = latest_measurements(history, run_blocks, ids, processes, exclude_location=exclude_location,
                                   with_growth=with_growth)
    return replace_keys(target, new_rows, "id_block", keys=ids)


def write_backfill_latest(spark: SparkSession, target_path: str, history: DataFrame, run_blocks: DataFrame, ids, processes: Sequence[str], *,
                          exclude_location: str | None = None, with_growth: bool = True) -> int:
    """J20 on a stored table (``sources.versions``): only the files that hold rows of the listed units are rewritten, and
    readers see the old content or the new. Returns the table's new version."""
    new_rows = latest_measurements(history, run_blocks, ids, processes, exclude_location=exclude_location, with_growth=with_growth)
    return replace_rows(spark, target_path, new_rows, "id_block", keys=ids)


def newest_values(history: DataFrame, parameter: str, key: str) -> DataFrame:
    """(key, data): the text value of ``parameter`` in the newest run per unit (``max(data)`` if it holds several rows)."""
    latest = latest_per_key(history.filter(F.col("step_parameter") == F.lit(parameter)), [key], "id_run")
    return latest.groupBy(key).agg(F.max("data").alias("data"))


def merge_fill_null(target: DataFrame, history: DataFrame, parameter: str, column: str, *,
                    key: str = "id_block") -> DataFrame:
    """Fill ``column`` of the target from the newest run's value of ``parameter`` per unit.

    The newest run per unit is chosen and joined back (``max(data)`` if it holds several rows);
    only rows whose target value is null and whose source text parses as a number are updated.
    """
    src = newest_values(history, parameter, key)
    num = safe_number(F.col("s.data"))
    return merge_update(target, src, [key], {column: num},
                        when=F.col(f"t.{column}").isNull() & num.isNotNull())


def write_fill_null(spark: SparkSession, target_path: str, history: DataFrame, parameter: str, column: str, *, key: str = "id_block") -> int:
    """J21 on a stored table (``sources.versions``): only files with a matching row whose ``column`` is null are rewritten."""
    num = safe_number(F.col("s.data"))
    return merge_rows(spark, target_path, newest_values(history, parameter, key), key, {column: num},
                      when=F.col(f"t.{column}").isNull() & num.isNotNull(), among=F.col(column).isNull())


def yield_per_parent(blocks: DataFrame, dims: DataFrame, growth_blocks: DataFrame, growth_runs: DataFrame,
                     tray_cells: DataFrame, plates: DataFrame, shipments: DataFrame, since, *,
                     size_family: str = "1x1") -> DataFrame:
    """Per parent — children, shipped children, newest birth, area averages, shrinkage
    ``avg(sqrt(child / parent))`` and tray occupation; parents grown after ``since`` with shipments.

    The parent's newest growth (``max`` id, newest end, total hours) picks its growth row for the
    grown area and its tray cell; a measured parent area wins over the grown one.
    """
    shipped = plates.join(shipments, "id_final_plate_shipment").filter(F.col("size_family") == F.lit(size_family)) \
        .groupBy("id_block").agg(F.min("timestamp").alias("shipping_time"))
    gb = growth_blocks.select("id_block", "id_run_growth")
    lg1 = gb.join(growth_runs.select("id_run_growth", "end_time", "run_duration"), "id_run_growth") \
        .groupBy("id_block").agg(F.max("id_run_growth").alias("id_run_growth"), F.max("end_time").alias("growth_end_time"),
                                 F.sum("run_duration").alias("total_run_duration"))
    lg = lg1.join(growth_blocks.select("id_block", "id_run_growth", "pre_width", "pre_length", "id_tray_cell"),
                  ["id_block", "id_run_growth"]).join(tray_cells.select("id_tray_cell", "width", "height"), "id_tray_cell")
    lg = lg.select(F.col("id_block").alias("_pid"), "growth_end_time", "total_run_duration",
                   (F.col("pre_width") * F.col("pre_length")).alias("_grown_area"),
                   (F.col("width") * F.col("height")).alias("tray_cell_area"))
    lg = lg.filter(F.col("growth_end_time") > F.lit(str(since)).cast(growth_runs.schema["end_time"].dataType))
    b = blocks.select("id_block", "parent_id_block", F.col("timestamp").alias("_born"))
    bq = dims.select("id_block", (F.col("initial_longer_dimension") * F.col("initial_shorter_dimension")).alias("_child_area"))
    pbq = dims.select(F.col("id_block").alias("_pbid"),
                      (F.col("initial_longer_dimension") * F.col("initial_shorter_dimension")).alias("_measured_parent"))
    j = b.join(bq, "id_block").join(lg, b["parent_id_block"] == lg["_pid"])
    j = j.join(shipped.select(F.col("id_block").alias("_sid")), F.col("id_block") == F.col("_sid"), "left")
    j = j.join(pbq, F.col("parent_id_block") == F.col("_pbid"), "left")
    parent_area = F.coalesce(F.col("_measured_parent"), F.col("_grown_area"))
    out = j.groupBy("parent_id_block", "tray_cell_area", "growth_end_time", "total_run_duration").agg(
        F.count("id_block").alias("breeded"), F.count("_sid").alias("shipped"), F.max("_born").alias("breeding_time"),
        F.avg(parent_area).alias("parent_area"), F.avg("_child_area").alias("child_avg_area"),
        F.avg(F.sqrt(F.col("_child_area") / parent_area)).alias("shrinkage"),
        F.avg(parent_area / F.col("tray_cell_area")).alias("parent_tray_occupation"))
    return out.filter(F.col("shipped") > 0)
