from pyspark.sql import functions as F

from stepwise.operators.latest import latest_per_key, top_row_per_key
from stepwise.sources.sinks import delete_keys, merge_update, only_new, replace_keys, write_replace
from tests.conftest import rows


def test_delete_keeps_null_keys_and_ignores_null_in_list(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert rows(delete_keys(t, [1, 1, 5], "k")) == [(None, "c"), (2, "b")]
    keys = spark.createDataFrame([(2,), (None,)], "k int")
    assert rows(delete_keys(t, keys, "k")) == [(None, "c"), (1, "a")]


def test_replace_keys_is_one_new_content(spark):
    t = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new"), (1, "new2")], "k int, v string")
    assert rows(replace_keys(t, new, "k", keys=[1, 2])) == [(1, "new"), (1, "new2"), (3, "old")]


def test_merge_update_only_where_null_and_parsable(spark):
    t = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, None)], "id int, x double")
    s = spark.createDataFrame([(1, "7.5"), (2, "9"), (3, "bad")], "id int, data string")
    num = F.col("s.data").try_cast("double")
    got = merge_update(t, s, ["id"], {"x": num}, when=F.col("t.x").isNull() & num.isNotNull())
    assert rows(got) == [(1, 7.5), (2, 5.0), (3, None), (4, None)]


def test_only_new_null_aware(spark):
    runs = spark.createDataFrame([(1,), (2,)], "id int")
    done = spark.createDataFrame([(1,)], "id int")
    assert rows(only_new(runs, done, "id")) == [(2,)]


def test_write_replace_can_rewrite_its_own_source(spark, tmp_path):
    p = str(tmp_path / "tbl")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(p)
    src = spark.read.parquet(p)
    write_replace(src.withColumn("extra", F.lit(None).cast("string")), p)
    assert rows(spark.read.parquet(p)) == [(1, "a", None)]


def test_latest_per_key_keeps_ties_and_chooser_only_steers(spark):
    h = spark.createDataFrame([(1, 10, "P", "x"), (1, 10, "Q", "y"), (1, 12, "Q", "z"), (2, 3, "P", "w")],
                              "u int, run int, proc string, data string")
    got = latest_per_key(h, ["u"], "run", chooser=F.col("proc") == "P")
    # unit 1: run 12 is ignored by the chooser, both rows of run 10 come back (also the 'Q' one)
    assert rows(got, "u", "run", "data") == [(1, 10, "x"), (1, 10, "y"), (2, 3, "w")]


def test_top_row_per_key_desc_with_tiebreak(spark):
    r = spark.createDataFrame([(1, "2024-01-01", "100"), (1, "2024-01-02", "090"), (1, "2024-01-02", "095"),
                               (2, None, "1")], "id int, ts string, target string")
    got = top_row_per_key(r, ["id"], ["ts"], ["target"])
    assert rows(got, "id", "target") == [(1, "095"), (2, "1")]


def test_merge_stops_on_two_source_rows_of_one_key(spark):
    import pytest

    from stepwise.sources.sinks import merge_update
    t = spark.createDataFrame([(1, None), (2, 5.0), (None, 7.0)], "k int, v double")
    one = spark.createDataFrame([(1, 3), (9, 4), (None, 8)], "k int, w int")
    got = merge_update(t, one, ["k"], {"v": F.col("s.w")}, F.col("t.v").isNull())
    assert got.dtypes == t.dtypes and sorted((r.k or 0, r.v) for r in got.collect()) == [(0, 7.0), (1, 3.0), (2, 5.0)]
    with pytest.raises(Exception, match="several source rows"):
        merge_update(t, one.union(one), ["k"], {"v": F.col("s.w")}).collect()
