from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from stepwise.functions import timeops as T


def test_local_midnight_across_dst_end():
    # 2025-11-03 05:00Z is 2025-11-02 21:00 PST -> local midnight 2025-11-02 00:00 PDT = 07:00Z
    assert T.local_midnight_of(datetime(2025, 11, 3, 5, 0), "America/Los_Angeles") == datetime(2025, 11, 2, 7, 0)


def test_subtraction_before_truncation():
    # interval 14+1 day is subtracted from the instant, then truncated in local time
    as_of = datetime(2024, 1, 31, 0, 0)
    assert T.local_midnight_of(as_of, days_back=15) == datetime(2024, 1, 15, 8, 0)
    assert T.local_midnight_of(as_of) == datetime(2024, 1, 30, 8, 0)


def test_local_midnight_column_matches_python(spark):
    instants = [datetime(2025, 3, 9, 9, 59), datetime(2025, 3, 9, 10, 1), datetime(2025, 11, 2, 8, 30),
                datetime(2025, 11, 3, 5, 0), datetime(2024, 1, 1, 7, 59), datetime(2024, 1, 1, 8, 0)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(instants)], "i int, t timestamp_ntz")
    got = {r.i: r.m for r in df.select("i", T.local_midnight("t").alias("m")).collect()}
    for i, t in enumerate(instants):
        assert got[i] == T.local_midnight_of(t), t


def test_sunday_week_and_percent_u_against_python(spark):
    days = [date(2014, 1, 1) + timedelta(days=k) for k in range(4000)]
    df = spark.createDataFrame([(d,) for d in days], "d date").withColumn("t", F.col("d").cast("timestamp_ntz"))
    out = df.select("d", T.sunday_week("t").alias("sw"), T.year_week_u("t").alias("wk")).collect()
    for r in out:
        py_sunday = r.d - timedelta(days=(r.d.weekday() + 1) % 7)
        assert r.sw.date() == py_sunday
        assert r.wk == r.d.strftime("%Y-%U")


def test_parse_us_date_pivot_and_junk(spark):
    df = spark.createDataFrame([("1/5/24",), ("01/05/70",), ("1/5/69",), ("1/5/68",), ("TBD",), (None,), ("13/45/24",)], "s string")
    got = [r.d for r in df.select(T.parse_us_date("s").alias("d")).collect()]
    assert got == [date(2024, 1, 5), date(1970, 1, 5), date(1969, 1, 5), date(2068, 1, 5), None, None, None]


def test_whole_units_truncate_toward_zero(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 1, 59, 59), datetime(2024, 1, 1, 0, 0)),
                                (datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 1, 1, 59, 59))], "a timestamp_ntz, b timestamp_ntz")
    got = [r.m for r in df.select(T.whole_units("a", "b", "MINUTE").alias("m")).collect()]
    assert got == [119, -119]


def test_in_local_days_is_a_pushed_bare_column_filter(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(datetime(2024, 1, 20),)], "end_time timestamp_ntz").write.parquet(p)
    df = spark.read.parquet(p)
    q = df.filter(T.in_local_days(df, "end_time", datetime(2024, 1, 31), 15))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(end_time), GreaterThanOrEqual(end_time" in plan
    assert q.count() == 1


def test_registered_date_partition_is_pruned(spark, tmp_path):
    p = str(tmp_path / "log")
    rows_ = [(datetime(2024, 1, d, 12), date(2024, 1, d)) for d in (1, 10, 20, 29)]
    spark.createDataFrame(rows_, "end_time timestamp_ntz, end_date date").write.partitionBy("end_date").parquet(p)
    df = T.with_date_partition(spark.read.parquet(p), "end_time", "end_date")
    q = df.filter(T.in_local_days(df, "end_time", datetime(2024, 1, 31), 15))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(end_date" in plan and "2024-01-15" in plan
    assert "PushedFilters: [IsNotNull(end_time), GreaterThanOrEqual(end_time" in plan
    assert sorted(r.end_time.day for r in q.collect()) == [20, 29]


def test_two_tables_with_the_same_names_and_their_own_rules(spark, tmp_path):
    """One table by UTC date, one by local date, one by something else: each predicate uses its own table's rule."""
    instants = [datetime(2024, 1, d, h) for d in (14, 15, 16, 30) for h in (2, 12, 23)]
    zone = "America/Los_Angeles"
    tables = {}
    for name, day in (("utc", lambda t: t.date()), ("local", lambda t: T.local_wall_of(t, zone).date()), ("other", lambda t: date(1999, 1, 1))):
        path = str(tmp_path / name)
        spark.createDataFrame([(t, day(t), i) for i, t in enumerate(instants)], "end_time timestamp_ntz, end_date date, i int").write.partitionBy(
            "end_date").parquet(path)
        tables[name] = spark.read.parquet(path)
    utc = T.with_date_partition(tables["utc"], "end_time", "end_date")
    local = T.with_date_partition(tables["local"], "end_time", "end_date", zone)
    lo, hi = datetime(2024, 1, 15, 3), datetime(2024, 1, 16, 3)
    want = [i for i, t in enumerate(instants) if lo <= t <= hi]
    cases = [(utc, ">= 2024-01-15"), (local, ">= 2024-01-14"), (tables["other"], None), (utc.select("i", "end_time"), None),
             (local.filter("i >= 0").withColumn("j", F.col("i") + 1), ">= 2024-01-14")]
    for df, bound in cases:
        q = df.filter(T.between_instants(df, "end_time", lo, hi))
        assert sorted(r.i for r in q.collect()) == want
        pruned = q._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert (bound in pruned) if bound else ">=" not in pruned
