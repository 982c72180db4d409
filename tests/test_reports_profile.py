"""The two period reports with the reference process profile on hand-computed fixtures."""

from datetime import datetime

import pytest

from stepwise.plans.profiles import (BACK_END_FLOW, CYCLE_TRANSITIONS, PARENT_SEGMENT, segment_steps,
                                     transitions)
from stepwise.plans.reports import cycle_time_report, throughput_report

AS_OF = datetime(2025, 11, 4, 12, 0)  # 04:00 PST; today's local midnight = 2025-11-04 08:00Z
LOG_SCHEMA = ("id_block long, flow_name_in string, step_name string, step_name_next string, end_time timestamp_ntz, "
              "material_type_in string, cycle_time double")


def test_throughput_report_profile(spark):
    F_ = BACK_END_FLOW
    log = spark.createDataFrame([
        (1, F_, "702038", "702040", datetime(2025, 11, 3, 18), "Prod", 1.0),   # Block Prep, 920 thick -> 2 plates
        (2, F_, "702040", "704020", datetime(2025, 10, 25, 12), "Prod", 1.0),  # RIM, thickness 0 -> 460 -> 1
        (3, F_, "704070", "706015", datetime(2025, 10, 30, 12), "Prod", 1.0),  # Singulation|child (Plate) -> 1
        (4, F_, "702038", "702040", datetime(2025, 11, 4, 9), "Prod", 1.0),    # after today's local midnight
        (5, F_, "704050", "704060", datetime(2025, 11, 3, 12), "Prod", 1.0),   # parent segment, dropped at the end
        (6, F_, "702038", "702040", datetime(2025, 11, 3, 12), "Software Test", 1.0),
        (9, "Other", "702038", "702040", datetime(2025, 11, 3, 12), "Prod", 1.0),
    ], LOG_SCHEMA)
    dims = spark.createDataFrame([(1, 920.0), (2, 0.0), (5, None), (7, 500.0), (8, 500.0)], "id_block long, thickness double")
    ships = spark.createDataFrame([(7, datetime(2025, 11, 2, 12), "1x1"), (8, datetime(2025, 11, 2, 12), "2x2")],
                                  "id_block long, timestamp timestamp_ntz, size_family string")
    stock = spark.createDataFrame([(60.0,)], "plate_count double")
    grown = spark.createDataFrame([(70, 1, datetime(2025, 11, 3, 20), 2300.0), (71, 2, datetime(2025, 10, 25, 12), None),
                                   (72, 3, datetime(2025, 11, 3, 20), 5000.0)],
                                  "id_block long, id_run_growth long, end_time timestamp_ntz, new_thickness double")
    runs = spark.createDataFrame([(1, "1x1"), (2, "2x2"), (3, "Others")], "id_run_growth long, seed_size_type string")
    out = throughput_report(log, transitions(spark), ships, dims, stock, grown, runs, AS_OF, flow=F_)
    got = {(r.segment, r.step_order, r.period, r.master_product): r["yield"] for r in out.collect()}
    exp = {
        ("Block Prep", 2, "14d", "1x1"): 2 / 14, ("Block Prep", 2, "5d", "1x1"): 2 / 5, ("Block Prep", 2, "1d", "1x1"): 2.0,
        ("RIM", 3, "14d", "1x1"): 1 / 14, ("RIM", 3, "5d", "1x1"): 0.01, ("RIM", 3, "1d", "1x1"): 0.01,
        ("Singulation", 5, "14d", "1x1"): 1 / 14, ("Singulation", 5, "5d", "1x1"): 1 / 5, ("Singulation", 5, "1d", "1x1"): 0.01,
        ("Basic Surfin", 6, "14d", "1x1"): 0.01,
        ("Finish", 7, "14d", "1x1"): 1 / 14, ("Finish", 7, "5d", "1x1"): 1 / 5, ("Finish", 7, "1d", "1x1"): 0.01,
        ("Stock/30", 8, "5d", "1x1"): 2.0,
        ("Grown", 1, "14d", "1x1"): 3 / 14, ("Grown", 1, "14d", "2x2"): 4 / 14, ("Grown", 1, "14d", "D200"): 0.01,
        ("Grown", 1, "5d", "1x1"): 3 / 5, ("Grown", 1, "5d", "2x2"): 0.01, ("Grown", 1, "1d", "1x1"): 3.0,
        ("Block Prep", 2, "14d", "2x2"): 0.01,
    }
    for k, v in exp.items():
        assert got[k] == pytest.approx(v), k
    # 5 segments x 3 periods x 3 products (parent segment removed) + stock + grown 3 x 3
    assert len(got) == 5 * 9 + 1 + 9
    assert not any(k[0] == "Singulation" and k[1] == 4 for k in got)


def test_cycle_time_report_inherits_parent_hours(spark):
    F_ = BACK_END_FLOW
    log = spark.createDataFrame([
        (100, F_, "704050", "704060", datetime(2025, 11, 1, 12), "Prod", None),       # parent: cohort transition
        (100, F_, "704040", "704050", datetime(2025, 10, 31, 12), "Prod", 3 * 3600.0),  # parent step of the segment
        (101, F_, "704070", "706015", datetime(2025, 11, 2, 12), "Prod", None),       # child: own transition
        (101, F_, "704060", "704066", datetime(2025, 11, 2, 10), "Prod", 2 * 3600.0),  # child step
        (101, F_, "704066", None, datetime(2025, 11, 2, 11), "Prod", 9 * 3600.0),      # no next step: ignored
    ], LOG_SCHEMA)
    blocks = spark.createDataFrame([(101, 100), (102, 100)], "id_block long, parent_id_block long")
    out = cycle_time_report(log, transitions(spark, CYCLE_TRANSITIONS), segment_steps(spark), blocks, AS_OF,
                            flow=F_, parent_segment=PARENT_SEGMENT)
    got = {(r.segment_name, r.period): (r.segment_rank, r.cycle_hour_avg, r.cycle_hour_max, r.number_of_blocks)
           for r in out.collect()}
    # children 101 (3 h inherited + 2 h own) and 102 (3 h inherited); the parent's own row is dropped
    for period in ("90d", "30d", "7d"):
        assert got[("Singulation", period)] == (3, pytest.approx(4.0), pytest.approx(5.0), 2)
    assert got[("Block Prep", "90d")] == (1, 0.01, 0.01, None)
    assert [k for k in got if k[1] == "90d"] and len(got) == 5 * 3


def test_throughput_report_reference_filter(spark):
    F_ = BACK_END_FLOW
    log = spark.createDataFrame([(1, F_, "702038", "702040", datetime(2025, 11, 3, 18), "Prod", 1.0)], LOG_SCHEMA)
    dims = spark.createDataFrame([(1, 920.0)], "id_block long, thickness double")
    ships = spark.createDataFrame([], "id_block long, timestamp timestamp_ntz, size_family string")
    stock = spark.createDataFrame([(30.0,)], "plate_count double")
    grown = spark.createDataFrame([], "id_block long, id_run_growth long, end_time timestamp_ntz, new_thickness double")
    runs = spark.createDataFrame([], "id_run_growth long, seed_size_type string")
    out = throughput_report(log, transitions(spark), ships, dims, stock, grown, runs, AS_OF, flow=F_,
                            keep_period="5d", keep_product="1x1").collect()
    got = {(r.segment, r.step_order): r["yield"] for r in out}
    assert {r.period for r in out} == {"5d"} and {r.master_product for r in out} == {"1x1"}
    assert got[("Block Prep", 2)] == pytest.approx(2 / 5) and got[("Stock/30", 8)] == pytest.approx(1.0)
    assert got[("Grown", 1)] == 0.01 and got[("RIM", 3)] == 0.01
    assert [r.step_order for r in out] == sorted(r.step_order for r in out)


def test_segment_cycle_time_keeps_one_segment_with_median(spark):
    from stepwise.operators.grids import inline_rows
    from stepwise.plans.cycle import segment_cycle_time
    from stepwise.plans.profiles import CORING_RENAMES, CORING_SPLITS

    cohort = spark.createDataFrame([(1, 10, datetime(2025, 11, 1)), (2, 20, datetime(2025, 11, 2)),
                                    (3, None, datetime(2025, 11, 2))],
                                   "id_block long, parent_id_block long, WS_ship_out_time timestamp_ntz")
    log = spark.createDataFrame([
        (10, "302010", "x", 3600.0 * 4, "Prod", datetime(2025, 10, 1)),   # parent of 1: coring 4 h
        (1, "302011", "x", 3600.0 * 1, "Prod", datetime(2025, 10, 2)),    # child 1 itself: + 1 h -> 5 h
        (20, "302010", "x", 3600.0 * 2, "Prod", datetime(2025, 10, 1)),   # parent of 2: 2 h
        (3, "302010", "x", 3600.0 * 9, "Software Test", datetime(2025, 10, 1)),  # test material: ignored
        (3, "304020", "x", 3600.0 * 7, "Prod", datetime(2025, 10, 1)),    # TDL step, not Core
        (1, "302010", None, 3600.0 * 50, "Prod", datetime(2025, 10, 1)),  # no next step: ignored
    ], "id_block long, step_name string, step_name_next string, cycle_time double, material_type_in string, "
       "end_time timestamp_ntz")
    segs = inline_rows(spark, [("302", "Coring"), ("304", "TDL")], "segment_id string, segment_name string")
    out = segment_cycle_time(log, cohort, segs, AS_OF, splits=CORING_SPLITS, renames=CORING_RENAMES, segment="Core")
    got = sorted((r.child_plate, r.cycle_hour, r.median_cycle_hour) for r in out.collect())
    assert got == [(1, 5.0, 3.5), (2, 2.0, 3.5)]
