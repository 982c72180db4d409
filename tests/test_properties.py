"""Property tests: custom operators against brute-force Python on random inputs (hot keys, ties, nulls)."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stepwise.operators.joins import anti_null_aware, interval_join, latest_before
from stepwise.operators.lists import grouped_sorted_list
from stepwise.operators.ordered import median_over, shift_within

BASE = datetime(2024, 1, 1)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

keyed_values = st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 2, None]), st.integers(0, 50),
                                  st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40)


@SETTINGS
@given(keyed_values)
def test_shift_within_lead_property(spark, data):
    rows = [(i, k, o, v) for i, (k, o, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "i int, k int, o int, v int")
    got = {r.i: r.next_v for r in shift_within(df, ["k"], ["o", "i"], ["v"], offset=1, width=7).collect()}
    exp = {}
    for k in {r[1] for r in rows}:
        grp = sorted([r for r in rows if r[1] == k], key=lambda r: (r[2], r[0]))
        for a, b in zip(grp, grp[1:] + [None]):
            exp[a[0]] = b[3] if b else None
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "b", None]), st.one_of(st.none(), st.integers(0, 100))),
                min_size=1, max_size=40))
def test_median_property(spark, data):
    df = spark.createDataFrame([(i, k, None if v is None else float(v)) for i, (k, v) in enumerate(data)],
                               "i int, k string, v double")
    got = {r.i: r.m for r in median_over(df, ["k"], "v", width=13, name="m").collect()}
    for i, (k, _) in enumerate(data):
        vals = sorted(float(v) for kk, v in data if kk == k and v is not None)
        if not vals:
            assert got[i] is None
            continue
        pos = 0.5 * (len(vals) - 1)
        lo = int(pos)
        hi = min(lo + 1, len(vals) - 1)
        assert abs(got[i] - (vals[lo] + (pos - lo) * (vals[hi] - vals[lo]))) < 1e-9


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60), st.integers(0, 60)), min_size=1, max_size=30),
       st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60), st.integers(0, 60)), min_size=1, max_size=10))
def test_latest_before_property(spark, cfg, runs):
    cfg_rows = [(s, "p", cid, BASE + timedelta(hours=h)) for s, cid, h in cfg]
    run_rows = [(s, n, rid, BASE + timedelta(hours=h)) for n, (s, rid, h) in enumerate(runs)]
    right = spark.createDataFrame(cfg_rows, "st int, param string, cid long, t timestamp_ntz")
    left = spark.createDataFrame(run_rows, "st int, n int, rid long, t timestamp_ntz")
    got = {(r.n, r.param): r.last for r in latest_before(
        left, right, by=["st"], combos=["param"], left_id="rid", right_id="cid", left_time="t", right_time="t",
        width=9, name="last").collect()}
    exp = {}
    for s, n, rid, t in run_rows:
        if any(c[0] == s for c in cfg_rows):
            cands = [c[2] for c in cfg_rows if c[0] == s and c[2] < rid and c[3] < t]
            exp[(n, "p")] = max(cands) if cands else None
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 100)), min_size=1, max_size=30),
       st.lists(st.tuples(st.integers(0, 2), st.integers(0, 100), st.integers(0, 30)), min_size=1, max_size=10))
def test_interval_join_property(spark, pts, ivs):
    p = spark.createDataFrame([(i, k, BASE + timedelta(hours=h)) for i, (k, h) in enumerate(pts)], "pid int, pk int, t timestamp_ntz")
    iv = spark.createDataFrame([(j, k, BASE + timedelta(hours=s), BASE + timedelta(hours=s + d)) for j, (k, s, d) in enumerate(ivs)],
                               "iid int, ik int, s timestamp_ntz, e timestamp_ntz")
    got = sorted((r.pid, r.iid) for r in interval_join(p, iv, [("pk", "ik")], "t", "s", "e", width=3600 * 7).collect())
    exp = sorted((i, j) for i, (k, h) in enumerate(pts) for j, (kk, s, d) in enumerate(ivs) if k == kk and s <= h <= s + d)
    assert got == exp


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.sampled_from(["x", "y", "z", "10", "9"]))),
                min_size=1, max_size=30),
       st.lists(st.one_of(st.none(), st.integers(0, 3)), max_size=4))
def test_sorted_list_and_not_in_properties(spark, data, excluded):
    df = spark.createDataFrame(data, "k int, v string")
    got = {r.k: (r.lst, r.n) for r in grouped_sorted_list(df, ["k"], "v", "lst", count_name="n").collect()}
    for k in {d[0] for d in data}:
        vals = sorted(v for kk, v in data if kk == k and v is not None)
        assert got[k] == ((",".join(vals) if vals else None), len(vals))
    ex = spark.createDataFrame([(e,) for e in excluded], "k int")
    kept = sorted(r.k for r in anti_null_aware(df.select("k").distinct(), ex, "k").collect())
    if any(e is None for e in excluded):
        assert kept == []
    else:
        assert kept == sorted({d[0] for d in data} - set(excluded))
