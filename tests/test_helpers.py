from pyspark.sql import Window
from pyspark.sql import functions as F

from stepwise.operators import (delta_from_prev, join_back, next_value, per_day, prev_value, union_sources,
                                walk_tree, with_global_max, with_parent)
from tests.conftest import rows


def test_named_shift_helpers(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, 4.0), (2, 1, 1.0)], "k int, o int, v double")
    n = next_value(df, ["k"], ["o"], "v", width=1)
    p = prev_value(df, ["k"], ["o"], "v", width=1)
    d = delta_from_prev(df, "v", ["k"], ["o"], width=1)
    assert rows(n, "k", "o", "next_v") == [(1, 1, 7.0), (1, 2, 4.0), (1, 3, None), (2, 1, None)]
    assert rows(p, "k", "o", "last_v") == [(1, 1, None), (1, 2, 5.0), (1, 3, 7.0), (2, 1, None)]
    assert rows(d, "k", "o", "change_of_value") == [(1, 1, None), (1, 2, 2.0), (1, 3, -3.0), (2, 1, None)]


def test_global_max_join_back_parent_union(spark):
    df = spark.createDataFrame([(1, 3), (2, 9)], "id long, lvl int")
    assert [r.mx for r in with_global_max(df, "lvl", "mx").collect()] == [9, 9]
    picked = spark.createDataFrame([(2, 9)], "id long, lvl int")
    assert rows(join_back(df, picked, ["id", "lvl"])) == [(2, 9)]
    blocks = spark.createDataFrame([(1, 100), (2, None)], "id_block long, parent_id_block long")
    kids = spark.createDataFrame([(1,), (2,), (3,)], "id_block long")
    assert rows(with_parent(kids, blocks)) == [(1, 100), (2, None)]
    u = union_sources(df, spark.createDataFrame([(5,)], "id long"))
    assert rows(u) == [(1, 3), (2, 9), (5, None)]
    assert df.select(per_day(F.sum("lvl"), 4).alias("x")).first().x == 3.0


def test_walk_tree_levels(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (9, 10)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (9,)], "r long")
    assert rows(walk_tree(edges, roots)) == [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 3), (9, 9, 1), (9, 10, 2)]
