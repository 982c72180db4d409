"""Dyadic covers and searches: row counts that don't grow with the data, open ends, hot keys, odd id types."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stepwise.operators.dyadic import FAN, LastSmaller, cover, pieces
from stepwise.operators.joins import in_ids, interval_join, latest_before
from tests.conftest import rows

BASE = datetime(2024, 1, 1)


def test_covers_are_exact_and_short(spark):
    rng = random.Random(1)
    pairs = [(a, b) for a in range(-9, 20) for b in range(-9, 24)]
    pairs += [(a, a + rng.randrange(10 ** rng.randrange(1, 8))) for a in (rng.randrange(10**6) for _ in range(300))]
    df = spark.createDataFrame(pairs, "lo long, hi long")
    df = df.select("lo", "hi", cover(F.col("lo"), F.col("hi")).alias("c"), F.when(F.expr("lo <= hi"), pieces(F.col("lo"), F.col("hi"))).alias("p"))
    for r in df.collect():
        parts = sorted((n.node << n.level, (n.node + 1) << n.level) for n in r.c)
        if r.lo > r.hi:
            assert parts == []
            continue
        assert parts[0][0] == r.lo and parts[-1][1] == r.hi + 1
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(sum(n.level == k for n in r.c) <= 2 for k in {n.level for n in r.c})
        assert len({n.level for n in r.p}) == 1 and len(r.p) <= 17
        assert min(n.node << n.level for n in r.p) <= r.lo and max((n.node + 1) << n.level for n in r.p) > r.hi


def test_search_rows_per_probe_stay_within_the_height(spark):
    """One hot key with 50,000 leaves: a probe meets one node per level, not the key's leaves."""
    n = 50_000
    leaves = spark.range(n).selectExpr("named_struct('k', 1) key", "id code", f"cast({n} - id as long) value", "id item")
    tree = LastSmaller(leaves, n)
    assert tree.height == -(-n.bit_length() // FAN) == 3
    assert tree.nodes.count() <= n / 2**FAN * 1.1 + tree.height
    probes = spark.range(0, n, 50).selectExpr("named_struct('k', 1) key", "id code", f"cast({n} - id + id % 7 * 1000 - 2500 as long) bound")
    assert tree.climb(probes).count() <= tree.height * probes.count()
    got = {(r.code, r.bound): r.item for r in tree.find(probes).collect()}
    for r in probes.collect():
        # values fall as codes rise: the last code before is the best one if any is
        want = r.code - 1 if r.code and n - (r.code - 1) < r.bound else None
        assert got.get((r.code, r.bound)) == want


@pytest.mark.parametrize("kind", ["long", "wide", "text", "fraction"])
def test_latest_before_on_any_id_type(spark, kind):
    rng = random.Random(5)
    name = {"long": lambda i: i, "wide": lambda i: (i - 100) * (1 << 55), "text": lambda i: f"same prefix {i:04d}", "fraction": lambda i: i / 8}[kind]
    sql = {"long": "long", "wide": "long", "text": "string", "fraction": "double"}[kind]
    cfg = [(rng.choice([1, 1, None]), "p", name(i), BASE + timedelta(hours=200 - i + rng.randrange(30))) for i in range(1, 200)]
    left = [(k, n, name(rng.randrange(0, 201)), BASE + timedelta(hours=rng.randrange(230))) for n in range(60) for k in (1, None)]
    right = spark.createDataFrame(cfg, f"k int, c string, rid {sql}, t timestamp_ntz")
    probes = spark.createDataFrame(left, f"k int, n int, lid {sql}, t timestamp_ntz")
    got = latest_before(probes, right, by=["k"], combos=["c"], left_id="lid", right_id="rid", left_time="t", right_time="t", width=40, name="best")
    want = {(k, n): max((r for kk, _, r, rt in cfg if kk == k and r < lid and rt < t), default=None) for k, n, lid, t in left}
    assert {(r.k, r.n): r.best for r in got.collect()} == want


def test_latest_before_without_candidates(spark):
    left = spark.createDataFrame([(1, 5, 7)], "k int, lid long, t long")
    none = spark.createDataFrame([], "k int, c string, rid long, t2 long")
    assert latest_before(left, none, by=["k"], combos=["c"], left_id="lid", right_id="rid", left_time="t", right_time="t2", width=5).count() == 0


def points_and_intervals(spark, seed=3):
    rng = random.Random(seed)
    at = lambda h: BASE + timedelta(hours=h)
    pts = [(i, rng.choice([0, 0, 0, 1, 2, None]), at(rng.randrange(2000)) if rng.random() < 0.95 else None) for i in range(400)]
    pts += pts[:20]  # repeated points
    ivs = [(j, rng.randrange(4), at(s), at(s + rng.choice([0, 1, 30, 700]))) for j, s in enumerate(rng.choices(range(2000), k=60))]
    ivs += [(100, 0, at(1500), datetime(9999, 12, 31)), (101, 1, datetime(1, 1, 1), datetime(9999, 12, 31)), (102, 2, datetime(9000, 1, 1), datetime(9999, 1, 1)),
            (103, 0, None, at(5)), (104, 0, at(9), None), (105, 0, at(9), at(8))]
    return (spark.createDataFrame(pts, "pid int, pk int, t timestamp_ntz"), spark.createDataFrame(ivs, "iid int, ik int, s timestamp_ntz, e timestamp_ntz"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("width", [1, 86400])
def test_interval_join_with_open_ends(spark, how, width):
    p, i = points_and_intervals(spark)
    got = interval_join(p, i, [("pk", "ik")], "t", "s", "e", width=width, how=how)
    want = p.join(i, (p.pk == i.ik) & (p.t >= i.s) & (p.t <= i.e), how)
    assert got.columns == want.columns
    assert rows(got, "pid", "iid", "e") == rows(want, "pid", "iid", "e")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_interval_join_without_rows(spark):
    p, i = points_and_intervals(spark)
    assert interval_join(p.limit(0), i, [("pk", "ik")], "t", "s", "e").count() == 0
    assert interval_join(p, i.limit(0), [("pk", "ik")], "t", "s", "e").count() == 0
    assert interval_join(p, i.limit(0), [("pk", "ik")], "t", "s", "e", how="left").count() == p.count()


def test_id_lists_take_the_columns_type(spark):
    text = spark.createDataFrame([("a",), ("7",), (None,)], "k string")
    number = spark.createDataFrame([(1,), (7,), (None,)], "k int")
    when = spark.createDataFrame([(BASE,)], "k timestamp_ntz")
    for df in (text, number, when):
        assert in_ids(df, "k", []).count() == 0
        assert in_ids(df, "k", [], negate=True).count() == df.count()
    assert [r.k for r in in_ids(text, "k", [7]).collect()] == ["7"]
    assert [r.k for r in in_ids(text, "k", [7], negate=True).collect()] == ["a"]
    assert [r.k for r in in_ids(number, "k", [7, None]).collect()] == [7]
    assert in_ids(number, "k", [7, None], negate=True).count() == 0


def test_rows_once_per_node_of_the_cover(spark):
    from stepwise.operators.dyadic import with_cover
    ranges = [(lo, hi) for lo in range(-9, 20) for hi in range(lo - 1, lo + 20)] + [(-(1 << 40), 1 << 41), (5, (1 << 50) - 1)]
    df = spark.createDataFrame(ranges, "lo long, hi long")
    nodes = {}
    for lo, hi, n in with_cover(df, F.col("lo"), F.col("hi")).select("lo", "hi", "_node").collect():
        nodes.setdefault((lo, hi), []).append(tuple(n))
    for lo, hi, array in df.select("lo", "hi", cover(F.col("lo"), F.col("hi"))).collect():
        mine = sorted((n << level, (n + 1) << level) for level, n in nodes.get((lo, hi), []))
        assert sorted(map(tuple, array)) == sorted(nodes.get((lo, hi), []))
        assert len(mine) <= 2 * max(hi - lo + 1, 1).bit_length()
        ends = [lo] + [e for _, e in mine]
        assert [s for s, _ in mine] == ends[:-1] and ends[-1] == max(hi + 1, lo)  # gapless, without overlap
