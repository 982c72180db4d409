import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stepwise.plans.backfill import backfill_latest, latest_measurements
from stepwise.plans.steps import completed_count, sequence_gaps, step_delay
from stepwise.plans.thickness import outlier_class
from tests.conftest import rows

AS_OF = datetime(2025, 11, 4, 12, 0)


def test_step_delay_window_and_fan_out(spark):
    log = spark.createDataFrame([
        (1, "F", "304020", datetime(2025, 11, 1, 12, 0)),
        (1, "F", "302020", datetime(2025, 10, 30, 12, 0)),
        (1, "F", "302020", datetime(2025, 10, 31, 12, 0)),
        (2, "F", "304020", datetime(2025, 10, 1, 12, 0)),  # outside the 15 local days
        (3, "G", "304020", datetime(2025, 11, 2, 12, 0)),  # other flow
        (4, "F", "304020", datetime(2025, 11, 4, 9, 0)),   # after today's local midnight (08:00Z) -> out
    ], "id_block long, flow_name_in string, step_name string, end_time timestamp_ntz")
    out = step_delay(log, "304020", "302020", AS_OF, flow="F")
    got = rows(out, "id_block", "cored_time", "time_delay")
    assert got == [(1, datetime(2025, 10, 30, 12, 0), 2.0), (1, datetime(2025, 10, 31, 12, 0), 1.0)]


def test_completed_count_rewrites_before_matching(spark):
    log = spark.createDataFrame([(1, "403020", datetime(2025, 11, 2)), (2, "303020", datetime(2025, 11, 2)),
                                 (3, "404020", datetime(2025, 11, 2))], "id_block long, step_name string, end_time timestamp_ntz")
    assert completed_count(log, ["303020"], AS_OF).first()[0] == 2


def test_sequence_gaps_drop_zero_length_first(spark):
    t0 = datetime(2025, 1, 1)
    log = spark.createDataFrame([(1, t0, t0 + timedelta(hours=1)), (1, t0 + timedelta(hours=5), t0 + timedelta(hours=5)),
                                 (1, t0 + timedelta(hours=3), t0 + timedelta(hours=4)),
                                 (1, t0 + timedelta(hours=4), t0 + timedelta(hours=6))],
                                "id_block long, start_time timestamp_ntz, end_time timestamp_ntz")
    got = rows(sequence_gaps(log), "this_end", "next_start", "time_diff")
    # the zero-length row at 05:00 is ignored; 01:00 -> 03:00 is a gap of 2 h, 04:00 -> 04:00 is no gap
    assert got == [(t0 + timedelta(hours=1), t0 + timedelta(hours=3), 2)]


def test_outlier_classes_all_five_and_three(spark):
    df = spark.createDataFrame([(-90.0, 90.0), (-200.0, -85.0), (85.0, 150.0), (0.0, 81.0), (-81.0, 0.0), (-10.0, 10.0),
                                (None, None)], "mn double, mx double")
    got = [(r.a, r.b) for r in df.select(outlier_class("mn", "mx", 80, 5).alias("a"), outlier_class("mn", "mx", 80, 3).alias("b")).collect()]
    assert got == [("Both", "Both"), ("AllMin", "Min"), ("AllMax", "Max"), ("Max", "Max"), ("Min", "Min"), (None, None), (None, None)]


def test_backfill_chooser_filters_only_the_choice_and_keeps_ties(spark):
    hist = spark.createDataFrame([
        (1, 100, 7, datetime(2025, 1, 1), "Thin", "s", "len", "5.0", "WA"),
        (1, 101, 7, datetime(2025, 1, 1), "Other", "s", "len", "5.1", "WS"),   # same run, fetched although filtered
        (1, 102, 9, datetime(2025, 1, 2), "Thin", "s", "len", "6.0", "WS"),    # newer run but excluded location
        (2, 103, 3, datetime(2025, 1, 1), "Thin", "s", "len", "1.0", "WA"),    # unit 2 has no growth -> deleted only
    ], "id_block long, id_block_run long, id_run long, timestamp timestamp_ntz, process_name string, step_name string, "
       "step_parameter string, data string, location_name string")
    runs = spark.createDataFrame([(1, 50), (1, 60)], "id_block long, id_run_growth long")
    new = latest_measurements(hist, runs, [1, 2], ["Thin"], exclude_location="WS")
    assert rows(new, "id_block_run", "last_growth") == [(100, 60), (101, 60)]
    target = spark.createDataFrame([(1, 1, 1, datetime(2024, 1, 1), "p", "s", "len", "x", 0),
                                    (2, 2, 2, datetime(2024, 1, 1), "p", "s", "len", "x", 0),
                                    (None, 3, 3, datetime(2024, 1, 1), "p", "s", "len", "x", 0)],
                                   "id_block long, id_block_run long, id_run long, timestamp timestamp_ntz, process_name string, "
                                   "step_name string, step_parameter string, data string, last_growth long")
    out = backfill_latest(target, hist, runs, [1, 2], ["Thin"], exclude_location="WS")
    assert rows(out, "id_block", "id_block_run") == [(None, 3), (1, 100), (1, 101)]


def _brute_impact(changes, runs):
    """J19 by pairs: ``changes`` are (time, parameter, change), all on the runs' only station."""
    want = {}
    for rid, rate, s, e in runs:
        for t, p, d in changes:
            if s <= t <= e:
                got = want.setdefault((rid, rate), [[], None])
                got[0] += [p] if p is not None else []
                got[1] = got[1] if d is None else (got[1] or 0) + d
    return {k: (None if d is None else round(d, 6), ",".join(sorted(ps)) or None, len(ps)) for k, (ps, d) in want.items()}


def _impact_tables(spark, changes, runs):
    """One change per source station, each with a first value, so that its change is the difference."""
    rows = []
    for i, (t, p, d) in enumerate(changes):
        rows.append((2 * i, "s", datetime(2000, 1, 1), i, p, "0"))
        rows.append((2 * i + 1, "s", t, i, p, None if d is None else str(d)))
    ch = spark.createDataFrame(rows, "id_run long, station_name string, start_time timestamp, id_station long, step_parameter string, step_data string")
    edges = spark.createDataFrame([(i, 7) for i in range(len(changes))], "source_id_station long, target_id_station long")
    stations = spark.createDataFrame([(7,)], "id_station long")
    rr = spark.createDataFrame([(i, r, 7, s, e) for i, r, s, e in runs], "id_run_growth long, mean_growth_rate double, id_station long, start_time timestamp, end_time timestamp")
    return ch, edges, stations, rr


def test_change_impact_equals_pairs(spark):
    from stepwise.plans.runs import change_impact
    rnd = random.Random(19)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(0, 6 * 1440, 5))  # noqa: E731 - many equal times
    changes = [(at(), rnd.choice(["a", "b", "cc", None]), rnd.choice([None, 1.5, -2.0, 4.0])) for _ in range(150)]
    runs = [(k, rnd.choice([1.0, None]), *sorted((at(), at()))) for k in range(40)]
    t = changes[0][0]
    runs += [(100, 1.0, t, t), (101, 1.0, t, t + timedelta(hours=1)), (102, 1.0, datetime(2023, 1, 1), datetime(2030, 1, 1)),
             (103, 1.0, t.replace(hour=0, minute=0), t.replace(hour=23, minute=59)), (104, 1.0, t, t - timedelta(days=1))]
    runs += [runs[0], runs[40], runs[42], runs[42]]  # equal rows count again
    for width in (86400, 10 ** 8):
        out = change_impact(*_impact_tables(spark, changes, runs), since=datetime(2001, 1, 1), time_width=width)
        got = {(r[0], r[1]): (None if r[2] is None else round(r[2], 6), r[3], r[4]) for r in out.collect()}
        assert got == _brute_impact(changes, [r for r in runs if r[2] <= r[3]])


def test_change_impact_makes_no_pair_per_change_and_run(spark):
    """1,000 changes and 1,000 runs of one station on one day: no operator may make a row per pair (500,000 would be)."""
    from stepwise.plans.runs import change_impact
    day = datetime(2024, 1, 1)
    changes = [(day + timedelta(seconds=40 * i), "p", 1.0) for i in range(1000)]
    runs = [(k, 1.0, day, day + timedelta(seconds=40 * k + 1)) for k in range(1000)]
    df = change_impact(*_impact_tables(spark, changes, runs), since=datetime(2001, 1, 1))
    assert {r[0]: (r[2], r[3], r[4]) for r in df.collect()} == {k: (k + 1.0, ",".join("p" * (k + 1)), k + 1) for k in range(1000)}
    # the metrics of the plan that collect() ran, from the final adaptive plan
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 1000 <= most < 60_000


def test_change_impact_shuffles_rows_like_changes_plus_runs(spark):
    """400 changes and 1,500 runs of two days, fifty parameters: a run is shuffled as a few rows with all its parameters, not as
    one or more per parameter."""
    from stepwise.plans.runs import change_impact
    rnd = random.Random(5)
    at = lambda: datetime(2024, 1, 3) + timedelta(microseconds=rnd.randrange(6 * 86400 * 10**6))
    changes = [(at(), f"p{rnd.randrange(50)}", float(rnd.randrange(9))) for _ in range(400)]
    runs = [(k, 1.0, t - timedelta(days=2), t) for k, t in enumerate(at() for _ in range(1500))]
    df = change_impact(*_impact_tables(spark, changes, runs), since=datetime(2001, 1, 1))
    assert {(r[0], r[1]): (round(r[2], 6), r[3], r[4]) for r in df.collect()} == _brute_impact(changes, runs)
    written, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        rows = node.metrics().get("shuffleRecordsWritten")
        written += rows.get().value() if rows.isDefined() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 1500 <= written < 40_000


def test_change_impact_of_stations_with_many_rows(spark):
    """A station with most of the rows is spread over id buckets, one with a few is not: both have the same LAG."""
    from stepwise.plans.runs import change_impact
    rnd = random.Random(8)
    day = datetime(2024, 1, 1)
    log = [(i, "s", day + timedelta(hours=rnd.randrange(90)), rnd.choice([1] * 40 + [2, 3, 4, 5, None]), rnd.choice(["a", "b", None]), str(rnd.randrange(50)))
           for i in rnd.sample(range(5000), 400)]
    log += [(i, "s", day, 1, "a", d) for i, d in ((6000, "n/a"), (6001, "7"), (None, "3"))]
    runs = [(k, 1.0, 70 + k % 2, s, s + timedelta(hours=rnd.randrange(60))) for k, s in enumerate(day + timedelta(hours=rnd.randrange(90)) for _ in range(50))]
    edges = [(s, 70 + s % 2) for s in (1, 2, 3, 4)] * 2 + [(1, 70), (None, 70), (5, 99)]
    df = change_impact(
        spark.createDataFrame(log, "id_run long, station_name string, start_time timestamp, id_station long, step_parameter string, step_data string"),
        spark.createDataFrame(edges, "source_id_station long, target_id_station long"), spark.createDataFrame([(70,), (71,)], "id_station long"),
        spark.createDataFrame(runs, "id_run_growth long, mean_growth_rate double, id_station long, start_time timestamp, end_time timestamp"),
        id_width=500)
    number = lambda d: None if d == "n/a" else float(d)
    want, last = {}, {}
    for i, _, t, s, p, d in sorted(log, key=lambda r: (r[0] is not None, r[0] or 0)):
        before, last[s, p] = last.get((s, p)), number(d)
        change = None if before is None or number(d) is None else number(d) - before
        for target in {e[1] for e in edges if e[0] == s and s is not None}:
            for k, rate, station, lo, hi in runs:
                if station == target and lo <= t <= hi:
                    of = want.setdefault(k, [[], None])
                    of[0] += [p] if p is not None else []
                    of[1] = of[1] if change is None else (of[1] or 0) + change
    assert {r[0]: (r[2], r[3], r[4]) for r in df.collect()} == {k: (d, ",".join(sorted(ps)) or None, len(ps)) for k, (ps, d) in want.items()}
