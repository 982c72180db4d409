"""Incremental run verification (J06 + S12) as a Structured Streaming job.

The warehouse script loops over "runs ended recently and not yet in the target" and inserts one
aggregate per run. Here new run records arrive as files; each micro-batch is one set-based
``last_reading_per_run`` over the batch's runs, anti-joined against the rows already in the target,
and written to the target folder ``epoch=<batch id>``. The stream's checkpoint (in the shared
checkpoint folder) records which files were processed. A retried batch overwrites its own folder and
does not count that folder's rows as loaded, so a restarted or failed job resumes without duplicates
and without losses; ``availableNow`` drains what is there and stops, which suits a scheduled job.

A stream sees each run file once, but the readings of a run may arrive later. Each micro-batch therefore
writes its runs without a reading, as far as they are inside the window, to a **pending** table next to
the target (a folder per micro-batch, overwritten on a retry). Every drain ends with one re-check of the
pending runs, written to a folder of its own (``epoch=late-<as_of>-…``); the runs that are still pending and
still inside the window are carried into one new folder and the folders read are deleted. No run file is
read twice, so a drain's work grows with new and pending runs, not with history. A job that stops between
the two steps leaves runs in two pending folders, which does no harm: the re-check takes each once.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stepwise.functions.timeops import as_utc, between_instants
from stepwise.plans.runs import last_reading_per_run

TARGET_COLUMNS = ["id_run_growth", "id_growing_run", "end_time", "id_run_end_time"]


def _target_or_empty(spark: SparkSession, target_path: str, schema: StructType, but: str | None = None) -> DataFrame:
    """Rows of the target, without those of the folder ``epoch=<but>``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(target_path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        rows = spark.read.schema(StructType([*schema.fields, StructField("epoch", StringType())])).parquet(target_path)
        if but is not None:
            rows = rows.filter(F.col("epoch") != F.lit(but))
        return rows.select(*TARGET_COLUMNS)
    return spark.createDataFrame([], schema)


def pending_folder(target_path: str) -> str:
    """Where runs without a reading wait: next to the target, not in it."""
    return f"{target_path.rstrip('/')}__pending"


def _keep_pending(runs: DataFrame, loaded: DataFrame, target_path: str, part: str, as_of, window: timedelta) -> None:
    """Write the runs that may still get a reading (in the window, not loaded) as one folder of the pending table."""
    alive = runs.filter(between_instants(runs, "end_time", as_utc(as_of) - window, None) & (F.col("run_duration") > 0))
    ids = loaded.select(F.col("id_run_growth").alias("_loaded")).distinct()
    alive.join(ids, F.col("id_run_growth") == F.col("_loaded"), "left_anti").dropDuplicates(["id_run_growth"]).write.mode(
        "overwrite").parquet(f"{pending_folder(target_path)}/part={part}")


def pending_runs(spark: SparkSession, runs_schema: StructType, target_path: str) -> tuple[DataFrame, list[str]]:
    """The runs that wait for a reading, and the folders that hold them."""
    folder = pending_folder(target_path)
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    runs = spark.read.schema(runs_schema).parquet(*parts) if parts else spark.createDataFrame([], runs_schema)
    return runs.dropDuplicates(["id_run_growth"]), parts


def start_end_time_check(spark: SparkSession, runs_path: str, runs_schema: StructType, stations: DataFrame,
                         sensor: DataFrame, target_path: str, checkpoint_path: str, as_of, *,
                         window: timedelta = timedelta(hours=24 * 30), before: timedelta = timedelta(hours=2),
                         after: timedelta = timedelta(hours=1), glob: str | None = None, recursive: bool = True,
                         max_files_per_trigger: int | None = None, available_now: bool = True,
                         processing_time: str | None = None):
    """Start the incremental load; returns the ``StreamingQuery``.

    ``runs_path`` is a folder that receives run files (Parquet) with ``runs_schema``; ``glob``
    restricts the files read. The target is read afresh in every micro-batch for the NOT IN check.
    """
    reader = spark.readStream.schema(runs_schema).option("recursiveFileLookup", str(recursive).lower())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    runs = reader.parquet(runs_path)

    def process(batch: DataFrame, epoch_id: int) -> None:
        done = _target_or_empty(spark, target_path, _target_schema(batch), but=str(epoch_id))
        out = last_reading_per_run(batch, stations, sensor, done.select("id_run_growth"), as_of,
                                   window=window, before=before, after=after)
        # one folder per micro-batch, overwritten on a retry of the same epoch: exactly-once output
        out.select(*TARGET_COLUMNS).write.mode("overwrite").parquet(f"{target_path.rstrip('/')}/epoch={epoch_id}")
        loaded = _target_or_empty(spark, target_path, _target_schema(batch))
        _keep_pending(batch, loaded, target_path, str(epoch_id), as_of, window)

    w = runs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_path)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def _target_schema(batch: DataFrame) -> StructType:
    s = batch.schema
    return StructType([StructField("id_run_growth", s["id_run_growth"].dataType),
                       StructField("id_growing_run", s["id_growing_run"].dataType),
                       StructField("end_time", s["end_time"].dataType),
                       StructField("id_run_end_time", s["end_time"].dataType)])


def run_end_time_check(spark: SparkSession, runs_path: str, runs_schema: StructType, stations: DataFrame,
                       sensor: DataFrame, target_path: str, checkpoint_path: str, as_of, **kw) -> DataFrame:
    """Drain all available run files through the incremental load and return the target table."""
    q = start_end_time_check(spark, runs_path, runs_schema, stations, sensor, target_path, checkpoint_path, as_of,
                             available_now=True, **kw)
    q.awaitTermination()
    window = {k: kw[k] for k in ("window", "before", "after") if k in kw}
    load_late_readings(spark, runs_schema, stations, sensor, target_path, as_of, **window)
    return _target_or_empty(spark, target_path, _target_schema(spark.createDataFrame([], runs_schema)))


def load_late_readings(spark: SparkSession, runs_schema: StructType, stations: DataFrame, sensor: DataFrame, target_path: str, as_of, *,
                       window: timedelta = timedelta(hours=24 * 30), **around) -> None:
    """Load the pending runs whose readings have come, and carry the others as long as they are inside the window. Loaded
    runs are no longer pending, so a repeated call adds nothing."""
    runs, parts = pending_runs(spark, runs_schema, target_path)
    if not parts:
        return
    done = _target_or_empty(spark, target_path, _target_schema(runs))
    out = last_reading_per_run(runs, stations, sensor, done.select("id_run_growth"), as_of, window=window, **around)
    name = f"late-{as_of:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    out.select(*TARGET_COLUMNS).write.parquet(f"{target_path.rstrip('/')}/epoch={name}")
    _keep_pending(runs, _target_or_empty(spark, target_path, _target_schema(runs)), target_path, f"carried-{uuid.uuid4().hex}", as_of, window)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target_path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in parts:
        fs.delete(path(part), True)
