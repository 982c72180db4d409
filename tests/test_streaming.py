import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stepwise.session import checkpoint_dir
from stepwise.streaming.incremental import run_end_time_check


def test_incremental_load_is_exactly_once(spark):
    root = f"{checkpoint_dir(spark).rstrip('/')}/test_stream/{uuid.uuid4().hex}"
    t = datetime(2025, 1, 10)
    runs = spark.createDataFrame([(1, 11, 5, t - timedelta(hours=700), t, 10.0), (2, 12, 5, t - timedelta(hours=5), t, 0.0),
                                  (3, 13, 5, t - timedelta(hours=5), t, 3.0)],
                                 "id_run_growth long, id_growing_run long, id_station long, start_time timestamp_ntz, "
                                 "end_time timestamp_ntz, run_duration double")
    stations = spark.createDataFrame([(5, "shardA")], "id_station long, data_table string")
    sensor = spark.createDataFrame([
        ("shardA", t - timedelta(minutes=30), 11, ("p", "1")), ("shardA", t + timedelta(minutes=59), 11, ("p", "1")),
        ("shardA", t + timedelta(minutes=61), 11, ("p", "1")), ("shardA", t, 13, ("", "3")), ("shardB", t, 13, ("p", "3")),
    ], "data_table string, timestamp timestamp_ntz, id_run long, pyrometer struct<id_value:string,id_run_growth:string>")
    as_of = t + timedelta(hours=1)
    runs.filter("id_run_growth = 1").write.parquet(f"{root}/runs/b1")
    kw = dict(spark=spark, runs_path=f"{root}/runs", runs_schema=runs.schema, stations=stations, sensor=sensor,
              target_path=f"{root}/target", checkpoint_path=f"{root}/ckpt", as_of=as_of)
    first = run_end_time_check(**kw).collect()
    assert [(r.id_run_growth, r.id_run_end_time) for r in first] == [(1, t + timedelta(minutes=59))]
    runs.write.parquet(f"{root}/runs/b2")  # all runs again, including run 1
    second = run_end_time_check(**kw)
    assert sorted(r.id_run_growth for r in second.collect()) == [1]  # 2: zero duration, 3: empty id / other shard
    again = run_end_time_check(**kw)  # nothing new to read
    assert again.count() == 1


RUN_KIND = ("id_run_growth long, id_growing_run long, id_station long, start_time timestamp_ntz, "
            "end_time timestamp_ntz, run_duration double")
SENSOR_KIND = "data_table string, timestamp timestamp_ntz, id_run long, pyrometer struct<id_value:string,id_run_growth:string>"


def test_a_replayed_batch_keeps_its_rows(spark):
    root = f"{checkpoint_dir(spark).rstrip('/')}/test_replay/{uuid.uuid4().hex}"
    t = datetime(2025, 1, 10)
    runs = spark.createDataFrame([(i, 10 + i, 5, t - timedelta(hours=7), t, 3.0) for i in range(3)], RUN_KIND)
    stations = spark.createDataFrame([(5, "s")], "id_station long, data_table string")
    sensor = spark.createDataFrame([("s", t, 10 + i, ("p", str(i))) for i in range(3)], SENSOR_KIND)
    runs.write.parquet(f"{root}/runs/b1")
    kw = dict(spark=spark, runs_path=f"{root}/runs", runs_schema=runs.schema, stations=stations, sensor=sensor,
              target_path=f"{root}/target", checkpoint_path=f"{root}/ckpt", as_of=t + timedelta(hours=1))
    assert run_end_time_check(**kw).count() == 3
    # the batch wrote its folder but its commit is lost: the restarted query runs it again
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    commits = f"{root.removeprefix('file:')}/ckpt/commits"
    assert fs.delete(path(f"{commits}/0"), False)
    fs.delete(path(f"{commits}/.0.crc"), False)
    assert sorted(r.id_run_growth for r in run_end_time_check(**kw).collect()) == [0, 1, 2]


def test_readings_that_come_later_are_loaded(spark):
    root = f"{checkpoint_dir(spark).rstrip('/')}/test_late/{uuid.uuid4().hex}"
    t = datetime(2025, 1, 10)
    runs = spark.createDataFrame([(i, 10 + i, 5, t - timedelta(hours=7), t, 3.0) for i in range(3)], RUN_KIND)
    stations = spark.createDataFrame([(5, "s")], "id_station long, data_table string")
    readings = [("s", t, 10 + i, ("p", str(i))) for i in range(3)]
    runs.write.parquet(f"{root}/runs/b1")
    kw = dict(spark=spark, runs_path=f"{root}/runs", runs_schema=runs.schema, stations=stations, target_path=f"{root}/target",
              checkpoint_path=f"{root}/ckpt")
    first = run_end_time_check(sensor=spark.createDataFrame(readings[:1], SENSOR_KIND), as_of=t + timedelta(hours=1), **kw)
    assert [r.id_run_growth for r in first.collect()] == [0]
    for _ in range(2):  # a second call changes nothing
        later = run_end_time_check(sensor=spark.createDataFrame(readings, SENSOR_KIND), as_of=t + timedelta(hours=2), **kw)
        assert sorted(r.id_run_growth for r in later.collect()) == [0, 1, 2]


def test_sharded_sensor_is_pruned_by_the_run_join(spark, tmp_path):
    from stepwise.plans.runs import last_reading_per_run
    from stepwise.sources.tables import read_shards, write_shards

    t = datetime(2025, 1, 10)
    sensor = spark.createDataFrame(
        [(f"shard{i % 4}", t + timedelta(minutes=i % 50), 11, ("p", "1")) for i in range(200)],
        "data_table string, timestamp timestamp_ntz, id_run long, pyrometer struct<id_value:string,id_run_growth:string>")
    path = str(tmp_path / "sensor")
    write_shards(sensor, path, "data_table")
    runs = spark.createDataFrame([(1, 11, 5, t - timedelta(hours=5), t, 3.0)],
                                 "id_run_growth long, id_growing_run long, id_station long, start_time timestamp_ntz, "
                                 "end_time timestamp_ntz, run_duration double")
    stations = spark.createDataFrame([(5, "shard2")], "id_station long, data_table string")
    done = spark.createDataFrame([], "id_run_growth long")
    out = last_reading_per_run(runs, stations, read_shards(spark, path, "data_table"), done, t + timedelta(hours=1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    # shard2 rows are i % 4 == 2 at minute i % 50; the newest (i = 98 or 198) is minute 48
    assert [(r.id_run_growth, r.id_run_end_time) for r in out.collect()] == [(1, t + timedelta(minutes=48))]


def test_drains_dont_grow_with_history(spark):
    """Run files are read once: later drains work without them, pending runs stay in one carried folder until their readings
    come or the window has passed."""
    from stepwise.streaming.incremental import pending_folder, pending_runs

    root = f"{checkpoint_dir(spark).rstrip('/')}/test_pending/{uuid.uuid4().hex}"
    t = datetime(2025, 1, 10)
    stations = spark.createDataFrame([(5, "s")], "id_station long, data_table string")
    reading = lambda *ids: spark.createDataFrame([("s", t, 10 + i, ("p", str(i))) for i in ids] or [], SENSOR_KIND)
    kw = dict(spark=spark, runs_path=f"{root}/runs", stations=stations, target_path=f"{root}/target", checkpoint_path=f"{root}/ckpt")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in range(4):  # run 10 * day has its reading, 10 * day + 1 hasn't yet
        runs = spark.createDataFrame([(10 * day + k, 10 + 10 * day + k, 5, t - timedelta(hours=7), t, 3.0) for k in (0, 1)], RUN_KIND)
        runs.write.parquet(f"{root}/runs/b{day}")
        got = run_end_time_check(sensor=reading(*range(0, 40, 10)), runs_schema=runs.schema, as_of=t + timedelta(hours=1 + day), **kw)
        assert sorted(r.id_run_growth for r in got.collect()) == [10 * d for d in range(day + 1)]
        fs.delete(path(f"{root}/runs/b{day}"), True)
        waiting, parts = pending_runs(spark, runs.schema, f"{root}/target")
        assert len(parts) == 1 and sorted(r.id_run_growth for r in waiting.collect()) == [10 * d + 1 for d in range(day + 1)]
    late = dict(runs_schema=runs.schema, **kw)
    empty = spark.createDataFrame([], RUN_KIND)
    empty.write.mode("append").parquet(f"{root}/runs/b9")
    got = run_end_time_check(sensor=reading(1, 11), as_of=t + timedelta(days=2), **late)
    assert sorted(r.id_run_growth for r in got.collect()) == [0, 1, 10, 11, 20, 30]
    got = run_end_time_check(sensor=reading(1, 11, 21, 31), as_of=t + timedelta(days=31), **late)  # past the window
    assert sorted(r.id_run_growth for r in got.collect()) == [0, 1, 10, 11, 20, 30]
    assert pending_runs(spark, runs.schema, f"{root}/target")[0].count() == 0
    assert fs.exists(path(pending_folder(f"{root}/target")))
