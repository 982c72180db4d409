"""Buckets between sampled splitters: even parts on texts, ties, nulls; numbering without a window over all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepwise.operators import ordered
from stepwise.operators.grids import numbered, ordered_dim, rank_by_first
from stepwise.operators.ordered import global_dense_rank, neighbours, order_bucket, positions, shift_within
from tests.conftest import rows

SF = "/root/testdata/sf0.1"


def bucket_sizes(df, col):
    return sorted(r[0] for r in df.groupBy(order_bucket(df, col, 1).alias("b")).agg(F.count(F.lit(1))).select("count(1)").collect())


def test_text_buckets_are_even(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLED_PER_BUCKET", 64)
    names = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name")
    prefixed = names.select("c_custkey", F.concat(F.lit("the same long beginning " * 20), "c_name").alias("c_name"))
    for df in (names, prefixed):
        sizes = bucket_sizes(df, "c_name")
        assert len(sizes) > 100 and sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_buckets_rise_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLED_PER_BUCKET", 64)
    rng = random.Random(2)
    values = [None, "", "a", "é", "日", "z" * 300] + ["".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(2000)]
    for kind, vs in (("string", values), ("binary", [None if v is None else v.encode() for v in values])):
        df = spark.createDataFrame([(v,) for v in vs], f"v {kind}")
        got = df.select("v", order_bucket(df, "v", 1).alias("b")).collect()
        got = sorted(((r.v if r.v is None else r.v.encode() if kind == "string" else bytes(r.v)), r.b) for r in got if r.v is not None)
        assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and got[-1][1] > 5


def test_text_buckets_of_a_small_table_are_even_too(spark):
    sizes = bucket_sizes(spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_name"), "c_name")
    assert len(sizes) > 10 and sizes[-1] <= 4 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("per", [1, 64])
def test_neighbours_on_a_hot_text_key(spark, monkeypatch, per):
    monkeypatch.setattr(ordered, "SAMPLED_PER_BUCKET", per)  # 1: nearly every value has its own bucket
    rng = random.Random(4)
    data = [(i, rng.choice([0, 0, 0, 1, None]), rng.choice([None, *"abcdefgh", f"w{i}"]), rng.choice([None, 1, 2])) for i in range(600)]
    df = spark.createDataFrame(data, "i int, k int, t string, v int")
    got = neighbours(df, ["k"], ["t", "i"], ["v"], next_prefix="n_", prev_prefix="p_")
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.select("*", F.lead("v").over(w).alias("n_v"), F.lag("v").over(w).alias("p_v"))
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(shift_within(df, ["k"], ["t", "i"], ["v"], offset=-1, prefix="p_")) == rows(want.drop("n_v"))


def test_the_input_is_shuffled_once(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "value")
    out = neighbours(e, ["user_id"], ["ts"], ["value"], width=86400, next_prefix="n_", prev_prefix="p_")
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution()
    plan.executedPlan().execute()  # the final adaptive plan
    text = plan.executedPlan().toString()
    assert "ReusedExchange" in text or text.count("Scan parquet") == 1


def test_dense_ranks_and_positions(spark):
    rng = random.Random(6)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(300))])) for i in range(3000)]
    df = spark.createDataFrame(data, "i int, g string, x double")
    got = global_dense_rank(df, ["g", "x"], name="r")
    want = df.withColumn("r", F.dense_rank().over(Window.orderBy("g", "x")))
    key = lambda q: sorted((r.i, r.r) for r in q.collect())
    assert key(got) == key(want)
    placed = positions(df, ["i"], "p")
    assert all(r.p == r.i + 1 for r in placed.collect())
    # no window orders more than the parts' counts as a whole
    text = placed._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [row_number") == 1 and "_part" in text.split("Window [row_number")[1].split("\n")[0]


def test_numbering_of_a_large_table(spark):
    df = spark.range(200_000).withColumn("k", (F.col("id") * 7919) % 50_000)
    assert [tuple(r) for r in ordered_dim(df, "k", 5, "o").agg(F.min(F.col("o") - F.col("k")), F.max(F.col("o") - F.col("k"))).collect()] == [(5, 5)]
    assert numbered(df, 10, "n", ["id"]).where("n != id + 10").count() == 0
    first = rank_by_first(df, "k", "id", "r")
    assert (first.count(), first.agg(F.max("r")).first()[0]) == (50_000, 50_000)


def test_numbering_of_nothing(spark):
    none = spark.createDataFrame([], "k string, n int")
    assert ordered_dim(none, "k").count() == numbered(none, 1, order=["n", "k"]).count() == rank_by_first(none, "k", "n").count() == 0
    assert neighbours(none, ["n"], ["k"], ["n"], next_prefix="x_").count() == 0
