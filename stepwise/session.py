"""Session factory and session-level conventions."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every stepwise job relies on (time semantics) or benefits from (adaptive execution).
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
}
_TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}
# Context-level settings (only effective when the session is created here).
_CONTEXT = {
    # reliable checkpoints (recursion frontiers, materialised reports) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session conventions the library assumes (UTC session time zone, AQE on)."""
    for k, v in _REQUIRED.items():
        spark.conf.set(k, v)
    for k, v in _TUNING.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # pragma: no cover - static conf on some deployments
            pass
    return spark


def get_session(master: str | None = None, app: str = "stepwise", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's conventions.

    Jobs that write intermediates need ``spark.checkpoint.dir`` (``extra`` or the deployment's
    configuration); there is no default.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**_REQUIRED, **_TUNING, **_CONTEXT, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the deployment names in ``spark.checkpoint.dir``, registered
    with the SparkContext. The library never makes one of its own."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder that all executors share")
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()
