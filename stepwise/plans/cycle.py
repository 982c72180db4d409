"""Shipped-unit cohorts and per-segment cycle time with a median over the segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.rules import classify
from stepwise.functions.timeops import (
    DEFAULT_TZ, as_utc, between_instants, local_midnight_of, local_wall, shift, year_week_u,
)
from stepwise.operators.joins import any_key_join, with_parent
from stepwise.operators.ordered import median_over


def shipped_cohort(plates: DataFrame, shipments: DataFrame, blocks: DataFrame, as_of, *, days: float = 90,
                   tz: str = DEFAULT_TZ) -> DataFrame:
    """Units shipped strictly between local midnight ``days`` ago and today's, with their parent,
    ship time, size family, ``max`` finish/category and the ``%Y-%U`` week of local time + 1 week."""
    lo, hi = local_midnight_of(as_of, tz, days), local_midnight_of(as_of, tz, 0)
    fp = plates.filter(between_instants(plates, "timestamp", lo, hi, False, False))
    j = with_parent(fp.join(shipments, "id_final_plate_shipment"), blocks)
    g = j.groupBy("id_block", "parent_id_block", F.col("timestamp").alias("WS_ship_out_time"), "size_family").agg(
        F.max("surface_finish").alias("PIM_surface_finish"), F.max("output_category").alias("PIM_output_category"))
    week = year_week_u(shift(local_wall("WS_ship_out_time", tz), 7, "DAY"))
    return g.withColumn("WS_ship_out_week", week)


def segment_cycle_time(log: DataFrame, cohort: DataFrame, segments: DataFrame, as_of, *,
                       splits: dict[str, tuple[Sequence[tuple[Sequence[str], str]], str]],
                       renames: dict[str, str], log_days: float = 365, exclude_material: str | None = "Software Test",
                       segment: str | None = None, prefix_len: int = 3, median_width: float = 10.0) -> DataFrame:
    """Cycle hours per shipped child × segment, with the segment median on every row.

    Step rows of the child **or** its parent (equi join on exploded keys, no nested loop) are
    matched to segments by step-code prefix; ``splits`` refines some segments by step code
    (``{segment: ([(codes, label), …], fallback)}``); ``renames`` maps to report names (unlisted
    names become null, as in a CASE without ELSE). Hours = seconds / 3600, summed per child ×
    parent × segment × ship time; the exact median (``PERCENTILE_CONT(…, 0.5)``) is computed per
    segment without collecting a segment into one task. ``segment`` keeps a single segment.
    """
    since = as_utc(as_of)
    from datetime import timedelta
    since = since - timedelta(days=log_days)
    mh = log.filter(between_instants(log, "end_time", since, None, False)
                    & F.col("step_name_next").isNotNull() & F.col("cycle_time").isNotNull())
    if exclude_material is not None:
        mh = mh.filter(F.col("material_type_in") != F.lit(exclude_material))
    mh = mh.select("id_block", "step_name", "cycle_time",
                   F.substring("step_name", 1, prefix_len).alias("_segment_id"))
    co = cohort.select(F.col("id_block").alias("child_plate"), "parent_id_block", "WS_ship_out_time")
    j = any_key_join(co, mh, ["child_plate", "parent_id_block"], "id_block")
    fs = segments.select(F.col("segment_id").alias("_segment_id"), F.col("segment_name").alias("_fs_name"))
    j = j.join(fs, "_segment_id", "inner")
    name = F.col("_fs_name")
    rules = []
    for seg, (cases, fallback) in splits.items():
        inner = classify([(F.col("step_name").isin(list(codes)), label) for codes, label in cases], fallback)
        rules.append((name == F.lit(seg), inner))
    seg_name = classify(rules, name) if rules else name
    j = j.withColumn("_seg", seg_name).withColumn("_hours", F.col("cycle_time") / 3600)
    renamed = classify([(F.col("_seg") == F.lit(k), v) for k, v in renames.items()])
    per = j.groupBy("child_plate", "parent_id_block", renamed.alias("segment_name"), "WS_ship_out_time").agg(
        F.sum("_hours").alias("cycle_hour"))
    if segment is not None:
        per = per.filter(F.col("segment_name") == F.lit(segment))
    return median_over(per, ["segment_name"], "cycle_hour", width=median_width, name="median_cycle_hour")
