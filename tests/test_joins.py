import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stepwise.operators.joins import (any_key_join, anti_null_aware, full_join_coalesce, in_ids, interval_join,
                                      latest_before)
from tests.conftest import rows


def test_any_key_join_equals_or_join_without_nested_loop(spark):
    small = spark.createDataFrame([(1, 10), (2, None), (3, 3), (4, 10)], "id long, parent long")
    big = spark.createDataFrame([(k, f"r{k}") for k in [1, 2, 3, 10, 10, 11, None]], "unit long, tag string")
    got = any_key_join(small, big, ["id", "parent"], "unit")
    exp = big.join(small, (big.unit == small.id) | (big.unit == small.parent))
    assert rows(got, "id", "parent", "unit", "tag") == rows(exp, "id", "parent", "unit", "tag")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_interval_join_equals_brute_force(spark):
    rnd = random.Random(3)
    base = datetime(2024, 1, 1)
    pts = [(i, rnd.randint(0, 3), base + timedelta(hours=rnd.randint(0, 24 * 20))) for i in range(400)]
    ivs = []
    for j in range(60):
        s = base + timedelta(hours=rnd.randint(0, 24 * 20))
        ivs.append((j, rnd.randint(0, 3), s, s + timedelta(hours=rnd.randint(0, 24 * 5))))
    ivs.append((99, 1, None, base))
    p = spark.createDataFrame(pts, "pid int, pk int, t timestamp_ntz")
    i = spark.createDataFrame(ivs, "iid int, ik int, s timestamp_ntz, e timestamp_ntz")
    got = interval_join(p, i, [("pk", "ik")], "t", "s", "e", width=86400)
    exp = p.join(i, (p.pk == i.ik) & (p.t >= i.s) & (p.t <= i.e))
    assert rows(got, "pid", "iid") == rows(exp, "pid", "iid")


def test_not_in_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    with_null = spark.createDataFrame([(1,), (None,)], "k int")
    plain = spark.createDataFrame([(1,)], "k int")
    empty = spark.createDataFrame([], "k int")
    assert anti_null_aware(left, with_null, "k").count() == 0
    assert rows(anti_null_aware(left, plain, "k")) == [(2,)]
    assert rows(anti_null_aware(left, empty, "k")) == [(None,), (1,), (2,)]
    assert rows(in_ids(left, "k", [2, 2, 5])) == [(2,)]


def test_latest_before_matches_brute_force_including_exceptions(spark):
    rnd = random.Random(11)
    base = datetime(2024, 1, 1)
    cfg = []
    for rid in range(1, 300):
        st = rnd.randint(0, 2)
        # mostly co-monotone, sometimes a run created earlier starts later (exception path)
        t = base + timedelta(hours=rid + (rnd.randint(20, 60) if rnd.random() < 0.1 else 0))
        cfg.append((st, rnd.choice(["a", "b"]), rid, t))
    runs = [(st, 1000 + n, rid, base + timedelta(hours=rid - rnd.randint(0, 3))) for n, (st, rid) in
            enumerate((rnd.randint(0, 2), rnd.randint(1, 320)) for _ in range(150))]
    right = spark.createDataFrame(cfg, "station int, param string, id_run long, start_time timestamp_ntz")
    left = spark.createDataFrame(runs, "station int, run_key long, id_growing_run long, start_time timestamp_ntz")
    got = latest_before(left, right, by=["station"], combos=["param"], left_id="id_growing_run", right_id="id_run",
                        left_time="start_time", right_time="start_time", width=16, name="last")
    r = right.alias("r")
    l = left.alias("l")
    exp = l.join(right.select("station", "param").distinct().alias("c"), "station").alias("x") \
        .join(r, (F.col("x.station") == F.col("r.station")) & (F.col("x.param") == F.col("r.param"))
              & (F.col("r.id_run") < F.col("x.id_growing_run")) & (F.col("r.start_time") < F.col("x.start_time")), "left") \
        .groupBy("x.run_key", "x.param").agg(F.max("r.id_run").alias("last"))
    assert rows(got, "run_key", "param", "last") == rows(exp.select("run_key", "param", "last"))


def test_full_join_coalesce_keys_and_layer(spark):
    a = spark.createDataFrame([(1, 1, "top", 5.0), (1, 2, "C1", 6.0)], "p int, u int, layer string, v double")
    b = spark.createDataFrame([(1, 2, "C1", "x"), (2, 9, "bottom", "y")], "p int, u int, layer string, t string")
    got = full_join_coalesce(a, b, ["p", "u"], ["layer"])
    assert rows(got, "p", "u", "layer", "v", "t") == [(1, 1, "top", 5.0, None), (1, 2, "C1", 6.0, "x"), (2, 9, "bottom", None, "y")]


def test_grouped_sorted_list_equals_listagg(spark):
    from stepwise.operators.lists import grouped_sorted_list

    df = spark.createDataFrame([(1, "b", 1.0), (1, "a", 2.0), (1, "b", None), (1, None, 4.0), (2, None, None),
                                (3, "10", 1.0), (3, "9", 1.0)], "k int, p string, x double")
    got = grouped_sorted_list(df, ["k"], "p", "lst", count_name="n", sums={"s": "x"})
    exp = df.groupBy("k").agg(F.expr("listagg(p, ',') WITHIN GROUP (ORDER BY p)").alias("lst"),
                              F.count("p").alias("n"), F.sum("x").alias("s"))
    assert rows(got, "k", "lst", "n", "s") == rows(exp, "k", "lst", "n", "s")


def test_latest_before_materialized_equals_lazy(spark):
    from datetime import datetime, timedelta

    base = datetime(2024, 1, 1)
    right = spark.createDataFrame([(1, "a", i, base + timedelta(hours=(i * 7) % 11)) for i in range(1, 30)],
                                  "st int, p string, rid long, t timestamp_ntz")
    left = spark.createDataFrame([(1, n, 10 + n, base + timedelta(hours=n)) for n in range(12)],
                                 "st int, n int, lid long, t timestamp_ntz")
    kw = dict(by=["st"], combos=["p"], left_id="lid", right_id="rid", left_time="t", right_time="t", width=5, name="x")
    a = latest_before(left, right, **kw)
    b = latest_before(left, right, materialize=True, **kw)
    assert rows(a, "n", "x") == rows(b, "n", "x")


def test_latest_before_with_nulls_and_disagreeing_ids(spark):
    from stepwise.operators.joins import latest_before

    rnd = __import__("random").Random(3)
    cfg = [(k, c, i, 10_000 - i + rnd.randint(-40, 40)) for i in range(400) for k, c in [(rnd.choice([1, None]), rnd.choice(["a", None]))]]
    left = [(k, i, rnd.randint(9_500, 10_100)) for i in range(5, 420, 7) for k in (1, None)]
    r = spark.createDataFrame(cfg, "k int, c string, rid long, rt long")
    l = spark.createDataFrame(left, "k int, lid long, lt long")
    got = latest_before(l, r, by=["k"], combos=["c"], left_id="lid", right_id="rid", left_time="lt", right_time="rt", width=20, name="best")
    have = {(x.k, x.lid, x.lt, x.c): x.best for x in got.collect()}
    want = {}
    for k, lid, lt in left:
        for c in {c for kk, c, *_ in cfg if kk == k}:
            want[k, lid, lt, c] = max((rid for kk, cc, rid, rt in cfg if kk == k and cc == c and rid < lid and rt < lt), default=None)
    assert have == want


def test_interval_join_refuses_modes_that_keep_intervals(spark):
    import pytest

    from stepwise.operators.joins import interval_join
    df = spark.range(1).selectExpr("id k", "id t", "id s", "id e")
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            interval_join(df.select("k", "t"), df.select("k", "s", "e"), [("k", "k")], "t", "s", "e", width=1, how=how)


def test_text_ids(spark):
    from stepwise.operators.joins import in_ids
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in in_ids(df, "k", ["a", "x"]).collect()] == ["a"]
    assert [r.k for r in in_ids(df, "k", ["a"], negate=True).collect()] == ["b"]


def test_grouped_sorted_list_with_weights(spark):
    from stepwise.operators.lists import grouped_sorted_list
    df = spark.createDataFrame([(1, "b,", 2), (1, "a", 1), (1, "b,", 1), (1, "", 2), (1, None, 4), (1, "z", 0), (2, None, 3), (3, "x", 200_000)], "k int, p string, w long")
    got = {r.k: (r.lst, r.n) for r in grouped_sorted_list(df, ["k"], "p", "lst", sep=", ", count_name="n", weight="w").collect()}
    assert got == {1: (", , a, b,, b,, b,", 6), 2: (None, 0), 3: (", ".join(["x"] * 200_000), 200_000)}
