from pyspark.sql import functions as F

from stepwise.operators.grids import (Period, explode_periods, inline_rows, inline_values, numbered, ordered_dim,
                                      rank_by_first, report_grid)
from stepwise.sources.sinks import align, append_rows
from stepwise.sources.tables import read_jdbc, read_sheet, read_shards, write_shards
from tests.conftest import rows


def test_read_jdbc_accepts_an_injected_reader(spark):
    seen = []

    def reader(q):
        seen.append(q)
        return spark.createDataFrame([(1, "x")], "id long, v string")

    df = read_jdbc(spark, "jdbc:postgresql://db/x", "select id, v from t", reader=reader)
    assert seen == ["select id, v from t"] and df.count() == 1


def test_read_sheet_drops_header_rows(spark, tmp_path):
    p = tmp_path / "sheet.csv"
    p.write_text("Item,Dept,Status\n1,Back End QA,Open\n2,,Closed\n")
    df = read_sheet(spark, str(p), 3)
    assert rows(df) == [("1", "Back End QA", "Open"), ("2", None, "Closed")]


def test_append_rows_positional_columns(spark, tmp_path):
    p = str(tmp_path / "t")
    src = spark.createDataFrame([(1, "a")], "x long, y string")
    append_rows(src, p, ["id", "name"])
    append_rows(src, p, ["id", "name"])
    assert rows(spark.read.parquet(p)) == [(1, "a"), (1, "a")]
    assert align(src, ["id", "name"]).columns == ["id", "name"]


def test_sharded_write_prunes_partitions(spark, tmp_path):
    p = str(tmp_path / "s")
    write_shards(spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "v long, shard string"), p, "shard")
    df = read_shards(spark, p, "shard", ["A", "C"])
    assert rows(df, "v") == [(1,), (3,)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "IN (A,C)" in plan


def test_inline_values_offsets_and_numbering(spark):
    v = inline_values(spark, ["90d", "30d", "7d"], "period", offset_name="period_rank")
    assert rows(v) == [("30d", 1), ("7d", 2), ("90d", 0)]
    n = numbered(inline_rows(spark, [("a",), ("b",), ("c",)], "s string"), 301, "pos")
    assert rows(n) == [("a", 301), ("b", 302), ("c", 303)]


def test_ordered_dims_and_grid(spark):
    t = inline_rows(spark, [("702038", "Prep"), ("702040", "RIM"), ("710035", "Finish"), ("710035", "Finish")],
                    "step_name string, segment_name string")
    od = ordered_dim(t, "step_name", 2, "step_order")
    assert sorted({(r.step_name, r.step_order) for r in od.collect()}) == [("702038", 2), ("702040", 3), ("710035", 4)]
    fs = inline_rows(spark, [("a", "X|p", 0), ("b", "Y", 1), ("c", "X|c", 2)], "step_name string, segment_name string, pos int")
    rb = rank_by_first(fs, F.split_part("segment_name", F.lit("|"), F.lit(1)), "pos", "r")
    assert rows(rb) == [("X", 1), ("Y", 2)]
    g = report_grid(t.select("segment_name").distinct(), period=["14d", "5d"], product=["1x1", "2x2", "D200"])
    assert g.count() == 3 * 2 * 3


def test_explode_periods_tags_each_matching_period(spark):
    df = spark.createDataFrame([(1, 3), (2, 10)], "id int, age int")
    out = explode_periods(df, [(Period("7d", 0, 7), F.col("age") <= 7), (Period("30d", 1, 30), F.col("age") <= 30)])
    assert rows(out, "id", "period", "_divisor") == [(1, "30d", 30.0), (1, "7d", 7.0), (2, "30d", 30.0)]
