"""Skew-safe ordered operators equal the plain window they replace, including a hot key that spans
many order buckets, ties and nulls."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepwise.operators.ordered import (global_dense_rank, median_over, ordered_rank, running_max_before,
                                        shift_within)
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    base = datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else rnd.randint(1, 40)  # key 0 holds a third of all rows
        t = base + timedelta(seconds=rnd.randint(0, 40 * 86400))
        v = float(rnd.randint(0, 500))
        data.append((k, t, v, i))
    data.append((None, base, 1.0, 99999))
    return spark.createDataFrame(data, "k int, t timestamp_ntz, v double, i int")


def test_shift_within_lead_matches_window(spark, skewed):
    got = shift_within(skewed, ["k"], ["t"], ["i"], offset=1, width=86400, prefix="next_")
    w = Window.partitionBy("k").orderBy("t", "i")
    exp = skewed.withColumn("next_i", F.lead("i").over(w))
    assert rows(got, "i", "next_i") == rows(exp, "i", "next_i")


def test_shift_within_lag_matches_window(spark, skewed):
    got = shift_within(skewed, ["k"], ["i"], ["v"], offset=-1, width=50, prefix="prev_")
    w = Window.partitionBy("k").orderBy("i", "v")
    exp = skewed.withColumn("prev_v", F.lag("v").over(w))
    assert rows(got, "i", "prev_v") == rows(exp, "i", "prev_v")


def test_ordered_rank_matches_row_number(spark, skewed):
    got = ordered_rank(skewed, ["k"], ["t", "i"], width=86400, name="rn", count_name="n")
    w = Window.partitionBy("k").orderBy("t", "i")
    exp = skewed.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert rows(got, "i", "rn", "n") == rows(exp, "i", "rn", "n")


def test_median_over_matches_percentile(spark, skewed):
    got = median_over(skewed, ["k"], "v", width=25, name="med")
    exp = skewed.withColumn("med", F.percentile("v", 0.5).over(Window.partitionBy("k")))
    a = {r.i: r.med for r in got.collect()}
    b = {r.i: r.med for r in exp.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_global_dense_rank_matches_window(spark, skewed):
    df = skewed.withColumn("g", F.when(F.col("v") > 250, "large").otherwise("small"))
    got = global_dense_rank(df, ["g", "i"], width=100, name="r", bucket_col="i")
    exp = df.withColumn("r", F.dense_rank().over(Window.orderBy("g", "i")))
    assert rows(got, "i", "r") == rows(exp, "i", "r")


def test_running_max_before_is_strict(spark):
    df = spark.createDataFrame([(1, 5, None, True), (1, 5, 5, False), (1, 3, 3, False), (1, 9, None, True),
                                (1, 1, 1, False), (2, 4, None, True)], "k int, o int, val int, probe boolean")
    got = running_max_before(df, ["k"], "o", "val", "probe", width=2, name="m")
    probes = sorted((r.o, r.m) for r in got.filter("probe").collect())
    assert probes == [(4, None), (5, 3), (9, 5)]


def test_no_unpartitioned_window_over_rows(spark, skewed):
    plan = shift_within(skewed, ["k"], ["t"], ["i"], width=86400)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_nan_is_the_largest_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 30.0, nan)] + [(2, float("inf")), (2, -1.0), (2, None), (2, nan)], "k int, v double")
    got = {(r.k, str(r.v)): r.r for r in ordered_rank(df.filter("v is not null"), ["k"], ["v"], width=10, name="r").collect()}
    assert got == {(1, "1.0"): 1, (1, "2.0"): 2, (1, "30.0"): 3, (1, "nan"): 4, (2, "-1.0"): 1, (2, "inf"): 2, (2, "nan"): 3}
    med = {r.k: r.m for r in median_over(df, ["k"], "v", width=10, name="m").collect()}
    assert med == {1: 16.0, 2: float("inf")}


def test_median_looks_at_the_middle_bucket_only(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [0] * 500 + list(range(1000))], "k int, v double")
    assert median_over(df, ["k"], "v", width=10, name="m").first()["m"] == 249.5
    empty = spark.createDataFrame([(1, None)], "k int, v double")
    assert median_over(empty, ["k"], "v", width=10, name="m").first()["m"] is None


@pytest.mark.parametrize("kind", ["string", "binary", "boolean", "decimal(10,2)", "date"])
def test_every_orderable_type_takes_the_one_path(spark, kind):
    raw = [("2024-01-0%d" % (i % 7 + 1) if kind == "date" else "true" if i % 2 else "false") if kind in ("date", "boolean") else str(i * 37 % 11)
           for i in range(40)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, t string").select("i", F.col("t").cast(kind).alias("o"), F.lit(1).alias("k"))
    got = shift_within(df, ["k"], ["o"], ["i"], offset=1, width=2)
    exp = df.withColumn("next_i", F.lead("i").over(Window.partitionBy("k").orderBy(F.col("o").asc_nulls_first(), "i")))
    assert rows(got, "i", "next_i") == rows(exp, "i", "next_i")


def test_types_without_an_order_bucket_are_refused(spark):
    df = spark.createDataFrame([(1, [1])], "k int, o array<int>")
    with pytest.raises(TypeError):
        shift_within(df, ["k"], ["o"], ["k"])
