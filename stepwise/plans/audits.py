"""Shipment listings and absence audits (J17 J18), work-order request rows (J23) and report
dimension loads (J27)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.functions.text import number_text
from stepwise.functions.timeops import as_utc, between_instants
from stepwise.operators.grids import inline_rows, numbered
from stepwise.operators.joins import anti_null_aware


def tray_shipments(trays: DataFrame, station_types: Sequence[str], as_of, *, days: float = 90) -> DataFrame:
    """Units placed in trays at the given station types in the last ``days``, renamed, newest first."""
    since = as_utc(as_of) - timedelta(days=days)
    t = trays.filter(F.col("station_type_name").isin(list(station_types))
                     & between_instants(trays, "timestamp", since, None, False))
    out = t.select(F.col("id_run").alias("transaction_id"), F.col("timestamp").alias("date_transacted"),
                   F.col("station_name").alias("vendor"), "id_block", "length", "width", "thickness", "weight",
                   "tray_name", "load_order")
    return out.orderBy(F.col("date_transacted").desc(), "tray_name", "load_order")


def audit_absent(children: DataFrame, dims: DataFrame, trays: DataFrame, log: DataFrame, step: str, as_of, *,
                 origin_like: str, days: float = 90) -> DataFrame:
    """Parents with recent children of a given origin, at their current tray position, that never
    passed ``step`` — with SQL ``NOT IN`` semantics (a null in the passed list empties the result)."""
    since = as_utc(as_of) - timedelta(days=days)
    passed = log.filter(F.col("step_name_next") == F.lit(step)).select("id_block").distinct()
    kids = children.filter(between_instants(children, "timestamp", since, None, False))
    kids = kids.select("id_block", "parent_id_block").join(
        dims.select("id_block", "batch_origin", "job_number"), "id_block")
    kids = kids.filter(F.col("batch_origin").like(origin_like))
    parents = kids.groupBy("parent_id_block").agg(F.max("batch_origin").alias("batch_origin"),
                                                  F.max("job_number").alias("job_number"))
    parents = anti_null_aware(parents, passed, "parent_id_block", "id_block")
    v = trays.select(F.col("id_block").alias("_vid"), "station_name", "location_name", "timestamp")
    j = parents.join(v, parents["parent_id_block"] == v["_vid"], "inner")
    return j.select("parent_id_block", "batch_origin", "job_number", "station_name", "location_name", "timestamp")


#: stands for the description in a request's fields
DESCRIPTION = object()


def work_order_requests(df: DataFrame, request: dict) -> DataFrame:
    """Per anomalous run, the multi-line description and the request object as JSON text.

    ``request`` names the object's fields in order; a value is a constant, a column, or ``DESCRIPTION``
    for the text, so the receiving system's names and ids stay with the caller. Posting the request is
    outside the library (an outward side effect); the DataFrame is the hand-off. Numbers are rounded
    half-up to 2 places before formatting.
    """
    desc = F.concat(F.col("station_name"), F.lit(" During Growth "), F.col("id_run_growth").cast("string"),
                    F.lit(" around the "), F.col("RD").cast("string"), F.lit(" Hour Detected Max Q Diff "),
                    number_text("Max_Q_diff"), F.lit("\n"),
                    F.lit("The previous Growth's Max Q Diff was "), number_text("prev_Max_Q_diff"), F.lit("\n"),
                    F.lit("Therefore Requesting a TNU Check"))
    obj = F.struct(*[(F.col("_desc") if v is DESCRIPTION else v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in request.items()])
    out = df.withColumn("_desc", desc)
    return out.select("id_run_growth", "asset_id", F.col("_desc").alias("description"),
                      F.to_json(obj).alias("request_json"))


def append_dimension(spark: SparkSession, target: DataFrame, rows: Sequence[Sequence], schema: str, *,
                     start_pos: int | None = None, pos_name: str = "pos", constants: dict | None = None) -> DataFrame:
    """The target's new content after appending literal rows.

    With ``start_pos`` the rows are numbered in literal order from that value
    (``ROW_NUMBER() OVER () + start - 1``); ``constants`` adds fixed columns. Columns are matched
    to the target by name.
    """
    new = inline_rows(spark, rows, schema)
    if start_pos is not None:
        new = numbered(new, start_pos, pos_name)
    for k, v in (constants or {}).items():
        new = new.withColumn(k, F.lit(v))
    new = new.select(*[F.col(c).cast(target.schema[c].dataType) for c in target.columns])
    return target.unionByName(new)
