"""Shared helpers of the training-data operators: table reads, shared-folder tables, sizes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local-mode session that
    names none gets a scratch folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: folders that ``stored`` has written in this program
_STORED: list[str] = []


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written in this program, and return how many there were. Call it once the results
    that read them are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    n = len(_STORED)
    while _STORED:
        p = path(_STORED.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: later jobs, and retries
    after a lost executor, read the files and don't repeat the work."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: rows in a batch between Spark and Python, where the session leaves Spark's own default: whole texts are
#: long, and ten thousand of them fill a worker's memory
BATCH_ROWS = 1_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, where their Python can't import it, and keep
    batches of whole texts small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_llm_package_sent", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="llm-package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(name))
    sc._llm_package_sent = True
