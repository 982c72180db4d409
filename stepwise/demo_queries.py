"""Demonstration queries: every job and operator run over the driver's tables.

The driver's tables are a generic star schema (orders, lineitem, customer, events, …), so each demo
maps them onto a job's inputs with plain projections/joins — Spark derives every input from the
given tables, so the work grows with them. The matching DuckDB SQL lives in ``demo_oracles``.

Fixed reference instants: ``events`` spans 2024-01-01..2024-01-30, ``orders`` 1995..2001-08-01.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.session import checkpoint_dir, configure

EVENTS_AS_OF = datetime(2024, 1, 31, 0, 0, 0)
ORDERS_AS_OF = datetime(2001, 8, 1, 0, 0, 0)
TZ = "America/Los_Angeles"


def scratch_folder(spark: SparkSession) -> str:
    """The checkpoint folder for demos that write. A local session that names none gets one here, so
    that the demos run on a single machine; the library itself never does that. Folders that demos
    make are deleted when the program ends."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stepwise-demo-"))
    return checkpoint_dir(spark).rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, deleted when the program ends."""
    path = f"{scratch_folder(spark)}/{name}/{uuid.uuid4().hex}"

    def clear() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is already gone; nothing else to do at exit
            pass

    atexit.register(clear)
    return path


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table as a (lazy) DataFrame; the handle is reused per session so the file listing
    and footer read happen once, not in every query."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a step log: unit = user, step = event type, finish = ts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id_block"), F.col("event_type").alias("step_name"),
                    F.col("ts").alias("end_time"), "event_id", "value", "props")


# ----------------------------------------------------------------------------- J01 J02 J04 J05

def q_step_delay(spark, sf_dir):
    from stepwise.plans.steps import step_delay
    configure(spark)
    return step_delay(event_log(spark, sf_dir), "purchase", "signup", EVENTS_AS_OF, days=15, tz=TZ)


def q_completed_count(spark, sf_dir):
    from stepwise.plans.steps import completed_count
    configure(spark)
    return completed_count(event_log(spark, sf_dir), ["click"], EVENTS_AS_OF, days=5, tz=TZ,
                           rewrites=[(r"^view", "click"), (r"^signup", "purchase")])


def q_units_at_step(spark, sf_dir):
    from stepwise.plans.steps import units_at_step
    configure(spark)
    return units_at_step(event_log(spark, sf_dir), ["error"], EVENTS_AS_OF, days=15, tz=TZ)


def events_with_duration(spark, sf_dir) -> DataFrame:
    """Events as intervals: start = ts, end = ts + value minutes (value in cents of a minute)."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select(F.col("user_id").alias("id_block"), F.col("ts").alias("start_time"),
                    F.timestamp_add("MICROSECOND", cents * F.lit(600000), F.col("ts")).alias("end_time"))


def q_sequence_gaps(spark, sf_dir):
    from stepwise.plans.steps import sequence_gaps
    configure(spark)
    return sequence_gaps(events_with_duration(spark, sf_dir), key="id_block", width=3 * 86400)


REGISTRY = {
    "step_delay": q_step_delay,
    "completed_count": q_completed_count,
    "units_at_step": q_units_at_step,
    "sequence_gaps": q_sequence_gaps,
}


# ----------------------------------------------------------------------------- J06

def q_last_reading_per_run(spark, sf_dir):
    """Orders as runs on their customer's nation station; line items as sensor readings sharded by
    the supplier's region; urgent orders are already in the target."""
    from datetime import timedelta

    from stepwise.plans.runs import last_reading_per_run
    configure(spark)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    runs = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id_run_growth"), F.col("o_orderkey").alias("id_growing_run"),
        F.col("c_nationkey").alias("id_station"), F.col("o_orderdate").alias("start_time"),
        F.timestamp_add("DAY", F.lit(60), F.col("o_orderdate")).alias("end_time"),
        (F.col("o_totalprice") - 100000).alias("run_duration"))
    n = table(spark, sf_dir, "nation")
    stations = n.select(F.col("n_nationkey").alias("id_station"),
                        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("data_table"))
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    sensor = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey).select(
        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("data_table"),
        F.col("l_shipdate").alias("timestamp"), F.col("l_orderkey").alias("id_run"),
        F.struct(F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.col("l_returnflag")).alias("id_value"),
                 F.col("l_orderkey").cast("string").alias("id_run_growth")).alias("pyrometer"))
    done = o.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("id_run_growth"))
    return last_reading_per_run(runs, stations, sensor, done, ORDERS_AS_OF, window=timedelta(days=365),
                                before=timedelta(days=60), after=timedelta(days=30))


def end_time_check_inputs(spark, sf_dir):
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    runs = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id_run_growth"), F.col("o_orderkey").alias("id_growing_run"),
        F.col("c_nationkey").alias("id_station"), F.col("o_orderdate").alias("start_time"),
        F.timestamp_add("DAY", F.lit(60), F.col("o_orderdate")).alias("end_time"),
        (F.col("o_totalprice") - 100000).alias("run_duration"), F.col("o_orderpriority").alias("priority"))
    stations = n.select(F.col("n_nationkey").alias("id_station"),
                        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("data_table"))
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    sensor = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == n.n_nationkey).select(
        F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("data_table"),
        F.col("l_shipdate").alias("timestamp"), F.col("l_orderkey").alias("id_run"),
        F.struct(F.when(F.col("l_linestatus") == "O", F.lit("")).otherwise(F.col("l_returnflag")).alias("id_value"),
                 F.col("l_orderkey").cast("string").alias("id_run_growth")).alias("pyrometer"))
    return runs, stations, sensor


def q_stream_end_time_check(spark, sf_dir):
    """J06 as a scheduled streaming load: run files arrive in two drops (urgent/high first, then all
    runs again); each drain appends only runs not yet in the target."""
    from datetime import timedelta

    from stepwise.streaming.incremental import run_end_time_check
    configure(spark)
    runs, stations, sensor = end_time_check_inputs(spark, sf_dir)
    root = own_folder(spark, "stepwise_stream")
    kw = dict(window=timedelta(days=365), before=timedelta(days=60), after=timedelta(days=30))
    runs.filter(F.col("priority").isin("1-URGENT", "2-HIGH")).write.parquet(f"{root}/runs/b1")
    run_end_time_check(spark, f"{root}/runs", runs.schema, stations, sensor, f"{root}/target", f"{root}/ckpt",
                       ORDERS_AS_OF, **kw)
    runs.write.parquet(f"{root}/runs/b2")
    return run_end_time_check(spark, f"{root}/runs", runs.schema, stations, sensor, f"{root}/target", f"{root}/ckpt",
                              ORDERS_AS_OF, **kw)


# ----------------------------------------------------------------------------- J07

def q_config_at_run(spark, sf_dir):
    """Purchases as growing runs; every other event of the same user is a configuration record."""
    from stepwise.functions.rules import Alias
    from stepwise.plans.runs import config_at_run
    configure(spark)
    e = table(spark, sf_dir, "events")
    runs = e.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id_run_growth"), F.col("event_id").alias("id_growing_run"),
        F.col("user_id").alias("id_station"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("station_name"),
        F.col("ts").alias("start_time"))
    config = e.filter(F.col("event_type") != "purchase").select(
        F.col("event_id").alias("id_run"), F.col("user_id").alias("id_station"), F.col("ts").alias("start_time"),
        F.when(F.col("value") > 100, "high").otherwise("low").alias("step_name"),
        F.col("event_type").alias("step_parameter"), F.col("props").alias("step_data"))
    aliases = [Alias("Clicks", values=["click"]), Alias("Views", like=["vi%"])]
    cols = [("clicks", "Clicks"), ("views", "Views"), ("signups", "signup"), ("errors", ["error"])]
    return config_at_run(runs, config, cols, aliases=aliases, width=500)


# ----------------------------------------------------------------------------- J08

def q_measure_over(spark, sf_dir):
    from stepwise.plans.runs import measure_over
    configure(spark)
    e = table(spark, sf_dir, "events")
    hist = e.select(F.col("user_id").alias("id_block"), F.col("event_type").alias("process_name"),
                    F.when(F.col("value") > 300, "other").otherwise("k").alias("step_parameter"),
                    F.when(F.col("value") < 1, "n/a").otherwise(F.regexp_extract("props", "([0-9]+)", 1)).alias("data"),
                    F.col("ts").alias("timestamp"), F.col("event_id").alias("id_run"))
    return measure_over(hist, ["click", "view", "signup"], "k", 40, EVENTS_AS_OF, days=30)


# ----------------------------------------------------------------------------- J09

def q_runs_missing_metric(spark, sf_dir):
    from stepwise.plans.runs import runs_missing_metric
    configure(spark)
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    blocks = li.select(F.col("l_partkey").alias("id_block"), F.col("l_orderkey").alias("id_run_growth"),
                       F.col("l_quantity").alias("new_thickness"),
                       F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("pre_thickness"),
                       (F.col("l_extendedprice") / 1000).alias("abs_clean_area_rect_210"))
    runs = o.select(F.col("o_orderkey").alias("id_run_growth"), (F.col("o_totalprice") / 1000).alias("run_duration"),
                    F.col("o_orderpriority").alias("hardware_platform"), F.col("o_orderdate").alias("end_time"),
                    F.col("o_orderstatus").alias("growing_location_name"))
    d, p = F.col("run_duration"), F.col("hardware_platform")
    classes = [((d >= 300) & p.like("1-%"), "Gem"), ((d >= 350) & p.like("2-%"), "Gem"), ((d >= 100) & (d < 200), "Plate")]
    return runs_missing_metric(blocks, runs, classes, ORDERS_AS_OF, days=30, before_date="2001-07-25",
                               location="O", tz=TZ)


# ----------------------------------------------------------------------------- J11

def q_flag_review(spark, sf_dir):
    from stepwise.plans.runs import flag_review
    configure(spark)
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    summary = li.groupBy(F.col("l_orderkey").alias("id_run_growth")).agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("char_block_count_240"))
    runs = o.select(F.col("o_orderkey").alias("id_run_growth"), F.col("o_orderdate").alias("end_time"),
                    F.timestamp_add("DAY", F.lit(-10), F.col("o_orderdate")).alias("start_time"),
                    (F.col("o_totalprice") / 1000).alias("run_duration"),
                    F.when(F.col("o_orderstatus") == "O", "Production").otherwise("R&D").alias("loading_purpose"))
    flags = o.select(F.col("o_orderkey").alias("id_run_growth"),
                     F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Flagged").otherwise("No Excursions")
                     .alias("excursion_types"))
    events = li.select(F.col("l_orderkey").alias("id_run_growth"), F.col("l_shipdate").alias("timestamp"))
    ids = o.filter(F.col("o_totalprice") > 100000).select("o_orderkey")
    reviewed = o.filter(F.col("o_totalprice") > 400000).select("o_orderkey")
    return flag_review(summary, runs, flags, events, ids, reviewed, ORDERS_AS_OF, days=90)


# ----------------------------------------------------------------------------- J12

def striation_inputs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("id_run_growth")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.when(F.min("value") < 1, "Test").otherwise("Production").alias("loading_purpose"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    ge = e.select(F.col("user_id").cast("string").alias("id_run_growth"), F.col("ts").alias("timestamp"),
                  (F.col("value") / 400).alias("range_incident_power"), (F.col("value") / 200).alias("range_chamber_pressure"),
                  (F.col("value") * 30).alias("range_reflected_power"), (k / 2).alias("range_ppb_n2"))
    return ge, runs


def striation_events(spark, sf_dir):
    from stepwise.plans.runs import classify_events
    ge, runs = striation_inputs(spark, sf_dir)
    ip, cp, rp = F.col("range_incident_power"), F.col("range_chamber_pressure"), F.col("range_reflected_power")
    rules = [(ip > 0.8, "incident_power_event"), (cp > 1, "chamber_pressure_event"), (rp > 6800, "reflected_power_event")]
    keep = (((ip > 0.8) & (rp > 6800)) | (cp > 1)) & (F.col("range_ppb_n2") < 45)
    return classify_events(ge, runs, rules, "vsp_counter_event", keep)


def q_classify_events(spark, sf_dir):
    configure(spark)
    return striation_events(spark, sf_dir)


# ----------------------------------------------------------------------------- J13

def q_label_audit(spark, sf_dir):
    from stepwise.plans.runs import label_audit
    configure(spark)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    units = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_custkey").alias("id_tray"),
                     F.col("o_orderpriority").alias("tray_name"))
    dims = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_custkey").alias("latest_id_run_growth"),
                    F.col("o_totalprice").alias("post_hep_bake_weight"),
                    F.when(F.col("o_orderstatus") == "P", "flag").alias("custom_workflow"))
    growth = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_custkey").alias("id_run_growth"),
                      F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice") / 1000).alias("final_clean_vol_cm3"))
    trays = c.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    ev = striation_events(spark, sf_dir)
    reasons = [(F.col("end_time") < F.lit("2024-01-10").cast("timestamp_ntz"), "Before ECN"),
               (F.col("hour_til_end") < 48, "close to end"),
               (F.col("final_clean_vol_cm3").isNull(), "No Charx"),
               (F.col("loading_purpose") != "Production", "Not Production"),
               (F.col("custom_workflow").isNotNull(), "Flagged but missed")]
    return label_audit(units, dims, growth, ev, trays, reasons, exclude_tray_like="%LOW%")


# ----------------------------------------------------------------------------- J19

def q_change_impact(spark, sf_dir):
    from stepwise.plans.runs import change_impact
    configure(spark)
    e, c, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    changes = e.select(F.col("event_id").alias("id_run"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("station_name"),
                       F.col("ts").alias("start_time"), F.col("user_id").alias("id_station"),
                       F.col("event_type").alias("step_parameter"),
                       F.when(F.col("value") < 1, "n/a").otherwise(F.col("value").cast("string")).alias("step_data"))
    edges = c.select(F.col("c_custkey").alias("source_id_station"), F.col("c_nationkey").alias("target_id_station"))
    stations = n.select(F.col("n_nationkey").alias("id_station"), F.col("n_name").alias("station_name"))
    p = e.filter(F.col("event_type") == "purchase")
    runs = p.join(c, p.user_id == c.c_custkey).select(
        F.col("event_id").alias("id_run_growth"), F.col("value").alias("mean_growth_rate"),
        F.col("c_nationkey").alias("id_station"), F.timestamp_add("DAY", F.lit(-2), F.col("ts")).alias("start_time"),
        F.col("ts").alias("end_time"))
    out = change_impact(changes, edges, stations, runs, since=datetime(2024, 1, 2), id_width=500, time_width=86400)
    return out.withColumn("change_of_n2", F.round("change_of_n2", 6))


REGISTRY.update({
    "last_reading_per_run": q_last_reading_per_run,
    "stream_end_time_check": q_stream_end_time_check,
    "config_at_run": q_config_at_run,
    "measure_over": q_measure_over,
    "runs_missing_metric": q_runs_missing_metric,
    "flag_review": q_flag_review,
    "classify_events": q_classify_events,
    "label_audit": q_label_audit,
    "change_impact": q_change_impact,
})


# ----------------------------------------------------------------------------- J03

SEGMENT_ROWS = [("AF0", "Coring"), ("AO0", "Coring"), ("NF0", "TDL"), ("NO0", "TDL"), ("RF0", "Shave/Trim"),
                ("RO0", "Shave/Trim")]
SEGMENT_SPLITS = {
    "Shave/Trim": ([(["RF0001", "RO0001"], "Trim"), (["RF0002", "RO0002"], "Shave")], "Shave/Trim Buffer and Char"),
    "TDL": ([(["NF0001", "NO0001"], "TDL"), (["NF0002", "NF0003", "NO0002", "NO0003"], "Split")], "TDL/Split"),
}
SEGMENT_RENAMES = {"Coring": "Core", "TDL": "TDL", "Split": "Split", "TDL/Split": "TDL/Split", "Trim": "Trim",
                   "Shave": "Shave", "Shave/Trim Buffer and Char": "Trim / Shave"}


def lineitem_step_log(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("id_block"),
                     F.concat("l_returnflag", "l_linestatus", F.lpad(F.col("l_linenumber").cast("string"), 4, "0")).alias("step_name"),
                     F.when(F.col("l_tax") > 0, F.lit("x")).alias("step_name_next"),
                     (F.col("l_quantity") * 3600).alias("cycle_time"),
                     F.when(F.col("l_discount") == 0, "Software Test").otherwise("Prod").alias("material_type_in"),
                     F.col("l_shipdate").alias("end_time"))


def q_segment_cycle_time(spark, sf_dir):
    from stepwise.operators.grids import inline_rows
    from stepwise.plans.cycle import segment_cycle_time, shipped_cohort
    configure(spark)
    o = table(spark, sf_dir, "orders")
    plates = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_orderkey").alias("id_final_plate_shipment"),
                      F.col("o_orderdate").alias("timestamp"))
    shipments = o.select(F.col("o_orderkey").alias("id_final_plate_shipment"), F.col("o_orderpriority").alias("size_family"),
                         F.col("o_orderstatus").alias("surface_finish"),
                         F.substring("o_orderpriority", 1, 1).alias("output_category"))
    blocks = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_custkey").alias("parent_id_block"))
    cohort = shipped_cohort(plates, shipments, blocks, ORDERS_AS_OF, days=90, tz=TZ)
    segs = inline_rows(spark, SEGMENT_ROWS, "segment_id string, segment_name string")
    return segment_cycle_time(lineitem_step_log(spark, sf_dir), cohort, segs, ORDERS_AS_OF,
                              splits=SEGMENT_SPLITS, renames=SEGMENT_RENAMES)


# ----------------------------------------------------------------------------- J10

def q_add_struct_field(spark, sf_dir):
    from stepwise.plans.imports import add_struct_field
    configure(spark)
    c = table(spark, sf_dir, "customer")
    df = c.select("c_custkey", F.struct(F.col("c_name").alias("Growth_ID"),
                                        F.col("c_mktsegment").alias("id_tray1")).alias("customFieldValues"))
    out = add_struct_field(df, "customFieldValues", "MFG_GrowthID", "string",
                           order=["Growth_ID", "id_tray1", "MFG_GrowthID"])
    names = ",".join(f.name for f in out.schema["customFieldValues"].dataType.fields)
    return out.select("c_custkey", F.col("customFieldValues.Growth_ID").alias("cf_growth_id"),
                      F.col("customFieldValues.id_tray1").alias("cf_id_tray1"),
                      F.col("customFieldValues.MFG_GrowthID").alias("cf_mfg_growth_id"),
                      F.lit(names).alias("cf_fields"))


# ----------------------------------------------------------------------------- J14 J15 J16

def sheet_rows(spark, sf_dir) -> DataFrame:
    """An untyped sheet export built from orders and customers, with its header row."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    name = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("?"))
            .when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), F.lit(None))
            .otherwise(F.concat(F.lit("CUSTOMER "), F.substring("c_name", 10, 9))))
    fields = {
        0: F.col("o_orderkey").cast("string"),
        2: F.when(F.col("o_orderpriority").like("1%"), F.concat(F.lit("Back End "), F.col("o_orderpriority")))
            .otherwise(F.col("o_orderpriority")),
        3: F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
        4: F.col("o_custkey").cast("string"),
        5: F.col("o_orderstatus"),
        6: F.col("o_orderpriority"),
        7: F.when(F.col("o_totalprice") < 20000, F.lit("TBD")).otherwise(F.date_format("o_orderdate", "M/d/yy")),
        12: F.concat(F.lit("wc-"), F.col("o_orderkey").cast("string")),
        13: F.concat(F.lit("f-"), F.col("o_custkey").cast("string")),
        16: name,
        18: F.col("c_mktsegment"),
    }
    cols = [(fields.get(i, F.lit(None).cast("string"))).alias(f"string_field_{i}") for i in range(19)]
    data = j.select(*cols)
    header = spark.createDataFrame([tuple(["Item"] + [f"h{i}" for i in range(1, 19)])],
                                   ", ".join(f"string_field_{i} string" for i in range(19)))
    return header.unionByName(data)


def imported_docs(spark, sf_dir):
    from stepwise.plans.imports import import_sheet
    return import_sheet(sheet_rows(spark, sf_dir), ORDERS_AS_OF, tz=TZ)


def q_import_sheet(spark, sf_dir):
    configure(spark)
    return imported_docs(spark, sf_dir)


def q_resolve_people(spark, sf_dir):
    from stepwise.plans.imports import resolve_people
    configure(spark)
    c = table(spark, sf_dir, "customer")
    users = c.select(F.col("c_custkey").alias("id_user"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
                     F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"))
    aliases = {"CUSTOMER 000000007": "Customer 000000008", "CUSTOMER 000000011": "nobody here"}
    return resolve_people(sheet_rows(spark, sf_dir), users, aliases=aliases)


def q_explode_list(spark, sf_dir):
    from stepwise.plans.imports import document_locations
    configure(spark)
    p = table(spark, sf_dir, "part")
    released = p.select(F.col("p_partkey").cast("string").alias("Part_Number"), F.col("p_name").alias("Site"))
    return document_locations(released, imported_docs(spark, sf_dir), sep=" ")


# ----------------------------------------------------------------------------- J17 J18

def q_tray_shipments(spark, sf_dir):
    from stepwise.plans.audits import tray_shipments
    configure(spark)
    li = table(spark, sf_dir, "lineitem")
    trays = li.select(F.col("l_orderkey").alias("id_run"), F.col("l_shipdate").alias("timestamp"),
                      F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station_name"),
                      F.when(F.col("l_returnflag") == "R", "External Slicing Vendor")
                      .when(F.col("l_returnflag") == "A", "External Slicing Buffer").otherwise("Internal").alias("station_type_name"),
                      F.col("l_partkey").alias("id_block"), F.col("l_quantity").alias("length"),
                      F.col("l_extendedprice").alias("width"), F.col("l_discount").alias("thickness"),
                      F.col("l_tax").alias("weight"), F.col("l_linestatus").alias("tray_name"),
                      F.col("l_linenumber").alias("load_order"))
    return tray_shipments(trays, ["External Slicing Buffer", "External Slicing Vendor"], ORDERS_AS_OF, days=90)


def q_audit_absent(spark, sf_dir):
    from stepwise.plans.audits import audit_absent
    configure(spark)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    children = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_custkey").alias("parent_id_block"),
                        F.col("o_orderdate").alias("timestamp"))
    dims = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_orderpriority").alias("batch_origin"),
                    F.col("o_orderstatus").alias("job_number"))
    trays = c.select(F.col("c_custkey").alias("id_block"), F.col("c_mktsegment").alias("station_name"),
                     F.col("c_name").alias("location_name"),
                     F.timestamp_add("DAY", F.col("c_nationkey"), F.lit("2000-01-01").cast("timestamp_ntz")).alias("timestamp"))
    log = o.select(F.col("o_custkey").alias("id_block"), F.col("o_orderstatus").alias("step_name_next"))
    return audit_absent(children, dims, trays, log, "P", ORDERS_AS_OF, origin_like="%URGENT%", days=365)


# ----------------------------------------------------------------------------- J23 J27

def q_work_order_requests(spark, sf_dir):
    from stepwise.plans.audits import DESCRIPTION, work_order_requests
    configure(spark)
    o = table(spark, sf_dir, "orders")
    runs = o.select(
        F.col("o_orderkey").alias("id_run_growth"), F.col("o_orderpriority").alias("station_name"),
        F.col("o_custkey").alias("RD"), (F.col("o_totalprice") / 7.0).alias("Max_Q_diff"),
        (F.col("o_totalprice") / 13.0).alias("prev_Max_Q_diff"), F.col("o_custkey").alias("intSiteID"),
        (F.col("o_orderkey") + 1000).alias("asset_id"))
    return work_order_requests(runs, {"kind": "WorkOrder", "type_id": 11, "priority_id": 22, "requested_by": 33, "site_id": F.col("intSiteID"),
                                      "status_id": 44, "text": DESCRIPTION})


NEW_DIMENSION_ROWS = [("s1", "Prep", "Block"), ("s2", "Prep", "Block"), ("s3", "Cut|parent", "Block"),
                      ("s4", "Cut|child", "Plate"), ("s5", "Finish", "Plate")]


def q_append_dimension(spark, sf_dir):
    from stepwise.operators.grids import ordered_dim
    from stepwise.plans.audits import append_dimension
    configure(spark)
    e = table(spark, sf_dir, "events")
    steps = e.groupBy(F.col("event_type").alias("step_name")).agg(F.count(F.lit(1)).alias("_n"))
    target = ordered_dim(steps, "step_name", 1, "pos").select(
        "step_name", F.concat(F.lit("seg|"), F.col("step_name")).alias("segment_name"), F.col("pos").cast("int").alias("pos"),
        F.lit("Block").alias("unit"), F.lit("events").alias("flow_name_in"))
    return append_dimension(spark, target, NEW_DIMENSION_ROWS, "step_name string, segment_name string, unit string",
                            start_pos=301, constants={"flow_name_in": "1x1-demo"})


# ----------------------------------------------------------------------------- S02 S09 F11 F15

def q_shard_scan(spark, sf_dir):
    from stepwise.sources.tables import read_shards, write_shards
    configure(spark)
    path = own_folder(spark, "stepwise_shards")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    write_shards(li, path, "l_returnflag")
    return read_shards(spark, path, "l_returnflag", ["A", "R"]).select("l_orderkey", "l_linenumber", "l_quantity",
                                                                       "l_returnflag")


def q_delete_by_key(spark, sf_dir):
    from stepwise.sources.sinks import delete_keys
    configure(spark)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    target = o.select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("o_custkey"),
                      "o_orderstatus")
    keys = c.filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return delete_keys(target, keys, "o_custkey")


def q_week_label(spark, sf_dir):
    from stepwise.functions.timeops import local_wall, shift, year_week_u
    configure(spark)
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", year_week_u(shift(local_wall("ts", TZ), 7, "DAY")).alias("week_label"))


def q_strict_least(spark, sf_dir):
    from stepwise.functions.nullops import strict_greatest, strict_least
    configure(spark)
    li = table(spark, sf_dir, "lineitem")
    d = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    t = F.when(F.col("l_tax") != 0, F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", strict_least(d, t).alias("least_dt"),
                     strict_greatest(d, t).alias("greatest_dt"))


REGISTRY.update({
    "segment_cycle_time": q_segment_cycle_time,
    "add_struct_field": q_add_struct_field,
    "import_sheet": q_import_sheet,
    "resolve_people": q_resolve_people,
    "explode_list": q_explode_list,
    "tray_shipments": q_tray_shipments,
    "audit_absent": q_audit_absent,
    "work_order_requests": q_work_order_requests,
    "append_dimension": q_append_dimension,
    "shard_scan": q_shard_scan,
    "delete_by_key": q_delete_by_key,
    "week_label": q_week_label,
    "strict_least": q_strict_least,
})


# ----------------------------------------------------------------------------- J20 J21 J22

def event_history(spark, sf_dir) -> DataFrame:
    """Events as a measurement history: one run per user-day, parameter = event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id_block"), F.col("event_id").alias("id_block_run"),
                    F.date_format("ts", "yyyyMMdd").cast("bigint").alias("id_run"), F.col("ts").alias("timestamp"),
                    F.when(F.col("value") > 50, "ProcA").otherwise("ProcB").alias("process_name"),
                    F.lit("st").alias("step_name"), F.col("event_type").alias("step_parameter"),
                    F.col("props").alias("data"),
                    F.when(F.col("value") > 400, "WS").otherwise("WA").alias("location_name"))


def q_backfill_latest(spark, sf_dir):
    from stepwise.plans.backfill import HISTORY_COLUMNS, backfill_latest
    configure(spark)
    hist = event_history(spark, sf_dir)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    run_blocks = o.select(F.col("o_custkey").alias("id_block"), F.col("o_orderkey").alias("id_run_growth"))
    ids = c.filter(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey")
    target = hist.filter(F.col("step_parameter") == "view").select(*HISTORY_COLUMNS, F.lit(-1).cast("bigint").alias("last_growth"))
    return backfill_latest(target, hist, run_blocks, ids, ["ProcA"], exclude_location="WS")


def q_merge_fill_null(spark, sf_dir):
    from stepwise.plans.backfill import merge_fill_null
    configure(spark)
    c, e = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    target = c.select(F.col("c_custkey").alias("id_block"),
                      F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("longest_dim"))
    hist = e.select(F.col("user_id").alias("id_block"), F.col("event_id").alias("id_run"),
                    F.col("event_type").alias("step_parameter"),
                    F.when(F.col("value") < 5, "bad").otherwise(F.col("value").cast("string")).alias("data"))
    return merge_fill_null(target, hist, "purchase", "longest_dim")


def q_yield_per_parent(spark, sf_dir):
    from stepwise.plans.backfill import yield_per_parent
    configure(spark)
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    blocks = o.select(F.col("o_orderkey").alias("id_block"), F.col("o_custkey").alias("parent_id_block"),
                      F.col("o_orderdate").alias("timestamp"))
    dims = o.select(F.col("o_orderkey").alias("id_block"), (F.col("o_totalprice") / 7777.0).alias("initial_longer_dimension"),
                    F.when(F.col("o_orderstatus") != "P", F.length("o_orderpriority").cast("double")).alias("initial_shorter_dimension"))
    gb = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("id_block"), F.col("o_orderkey").alias("id_run_growth"),
        (F.col("o_totalprice") / 7777.0).alias("pre_width"), (F.col("c_nationkey") + 2.0).alias("pre_length"),
        F.col("c_nationkey").alias("id_tray_cell"))
    gr = o.select(F.col("o_orderkey").alias("id_run_growth"), F.col("o_orderdate").alias("end_time"),
                  (F.col("o_totalprice") / 1000).alias("run_duration"))
    cells = n.select(F.col("n_nationkey").alias("id_tray_cell"), (F.col("n_nationkey") + 1).alias("width"),
                     (F.col("n_regionkey") + 1).alias("height"))
    plates = li.select(F.col("l_orderkey").alias("id_block"), F.col("l_partkey").alias("id_final_plate_shipment"),
                       F.col("l_shipdate").alias("timestamp"))
    ships = p.select(F.col("p_partkey").alias("id_final_plate_shipment"),
                     F.when(F.col("p_size") < 25, "1x1").otherwise("2x2").alias("size_family"))
    out = yield_per_parent(blocks, dims, gb, gr, cells, plates, ships, "1998-01-01")
    for col in ("total_run_duration", "parent_area", "child_avg_area", "shrinkage", "parent_tray_occupation"):
        out = out.withColumn(col, F.round(col, 6))
    return out


# ----------------------------------------------------------------------------- J24 J25

TRANSITION_ROWS = [("signup", "low", "Prep", "Block"), ("signup", "high", "RIM", "Block"),
                   ("click", "low", "Sing|parent", "Block"), ("click", "high", "Sing|child", "Plate"),
                   ("view", "low", "Surf", "Plate"), ("purchase", "low", "Finish", "Plate"),
                   ("purchase", "high", "Finish", "Plate")]
SEGMENT_STEP_ROWS = [("signup", "Prep", 0), ("click", "Sing|parent", 1), ("click", "Sing|child", 2),
                     ("view", "Surf", 3), ("purchase", "Finish", 4), ("signup", "RIM", 5)]


def event_step_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id_block"), F.col("event_type").alias("step_name"),
                    F.when(F.col("value") > 100, "high").otherwise("low").alias("step_name_next"),
                    F.col("ts").alias("end_time"), (F.col("value") * 60).alias("cycle_time"),
                    F.when(F.col("value") < 2, "Software Test").otherwise("Prod").alias("material_type_in"))


def q_throughput_report(spark, sf_dir):
    from stepwise.operators.grids import inline_rows
    from stepwise.plans.reports import throughput_report
    configure(spark)
    e, c, p = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    transitions = inline_rows(spark, TRANSITION_ROWS, "step_name string, step_name_next string, segment_name string, unit string")
    exclude = c.filter(F.col("c_acctbal") < 0).select("c_custkey")
    dims = c.select(F.col("c_custkey").alias("id_block"),
                    F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal") / 5).alias("thickness"))
    ships = e.filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("id_block"), F.col("ts").alias("timestamp"),
        F.when(F.col("value") < 250, "1x1").otherwise("2x2").alias("size_family"))
    stock = p.select(F.col("p_size").alias("plate_count"))
    gblocks = e.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("id_block"), F.col("ts").alias("end_time"), (F.col("value") * 10).alias("new_thickness"),
        F.col("user_id").alias("id_run_growth"))
    gruns = c.select(F.col("c_custkey").alias("id_run_growth"),
                     F.when(F.col("c_mktsegment") == "AUTOMOBILE", "1x1").when(F.col("c_mktsegment") == "BUILDING", "2x2")
                     .when(F.col("c_mktsegment") == "FURNITURE", "D200").otherwise("Others").alias("seed_size_type"))
    out = throughput_report(event_step_log(spark, sf_dir), transitions, ships, dims, stock, gblocks, gruns, EVENTS_AS_OF,
                            exclude_ids=exclude, parent_segment="Sing|parent", tz=TZ)
    return out.withColumn("yield", F.round("yield", 6))


def q_cycle_time_report(spark, sf_dir):
    from stepwise.operators.grids import inline_rows
    from stepwise.plans.reports import cycle_time_report
    configure(spark)
    c = table(spark, sf_dir, "customer")
    transitions = inline_rows(spark, TRANSITION_ROWS, "step_name string, step_name_next string, segment_name string, unit string")
    fs = inline_rows(spark, SEGMENT_STEP_ROWS, "step_name string, segment_name string, pos int")
    blocks = c.select(F.col("c_custkey").alias("id_block"), F.col("c_nationkey").cast("bigint").alias("parent_id_block"))
    exclude = c.filter(F.col("c_acctbal") < 0).select("c_custkey")
    out = cycle_time_report(event_step_log(spark, sf_dir), transitions, fs, blocks, EVENTS_AS_OF, exclude_ids=exclude,
                            parent_segment="Sing|parent", tz=TZ)
    return out.withColumn("cycle_hour_avg", F.round("cycle_hour_avg", 6)).withColumn("cycle_hour_max", F.round("cycle_hour_max", 6))


# ----------------------------------------------------------------------------- J26

def flow_tables(spark, sf_dir):
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    flows = r.select((F.col("r_regionkey") + 1000).cast("bigint").alias("FlowId"),
                     (F.col("r_regionkey") + 1000).cast("bigint").alias("DefinitionId"), F.col("r_name").alias("Name"),
                     F.lit("A").alias("Revision"), F.lit("1").alias("Version"),
                     F.concat(F.lit("region "), F.col("r_name")).alias("Description"), F.lit(False).alias("IsAlternate"))
    flows = flows.unionByName(n.select(
        (F.col("n_nationkey") + 2000).cast("bigint").alias("FlowId"), (F.col("n_nationkey") + 2000).cast("bigint").alias("DefinitionId"),
        F.col("n_name").alias("Name"), F.lit("B").alias("Revision"), F.col("n_regionkey").cast("string").alias("Version"),
        F.lit("nation").alias("Description"), (F.col("n_nationkey") > 20).alias("IsAlternate")))
    flows = flows.unionByName(c.select(
        (F.col("c_custkey") + 100000).alias("FlowId"), (F.col("c_custkey") + 100000).alias("DefinitionId"),
        F.col("c_name").alias("Name"), F.when(F.col("c_acctbal") >= 0, F.lit("C")).alias("Revision"),
        F.lit("1").alias("Version"), F.col("c_mktsegment").alias("Description"), F.lit(False).alias("IsAlternate")))
    subflows = n.select((F.col("n_regionkey") + 1000).cast("bigint").alias("SourceEntityId"),
                        (F.col("n_nationkey") + 2000).cast("bigint").alias("TargetEntityId"),
                        F.col("n_nationkey").cast("string").alias("Position"),
                        (F.col("n_nationkey") + 1).cast("bigint").alias("CorrelationID"),
                        F.col("n_name").alias("LogicalName"), F.lit(1).cast("bigint").alias("UniversalState"))
    subflows = subflows.unionByName(c.select(
        (F.col("c_nationkey") + 2000).cast("bigint").alias("SourceEntityId"), (F.col("c_custkey") + 100000).alias("TargetEntityId"),
        F.col("c_custkey").cast("string").alias("Position"), F.col("c_custkey").alias("CorrelationID"),
        F.lit(None).cast("string").alias("LogicalName"),
        F.when(F.col("c_acctbal") < 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("UniversalState")))
    flow_steps = s.select((F.col("s_nationkey") + 2000).cast("bigint").alias("SourceEntityId"),
                          F.col("s_suppkey").alias("TargetEntityId"), F.col("s_suppkey").cast("string").alias("Position"),
                          F.col("s_suppkey").alias("CorrelationID"),
                          F.when(F.col("s_acctbal") > 5000, F.lit("big")).alias("LogicalName"),
                          F.lit(1).cast("bigint").alias("UniversalState"))
    steps = s.select(F.col("s_suppkey").alias("StepId"), F.col("s_name").alias("Name"),
                     F.concat(F.lit("acct "), F.col("s_acctbal").cast("string")).alias("Description"),
                     F.col("s_nationkey").alias("DisplayOrder"))
    states = spark.createDataFrame([(1, "Active"), (2, "Inactive")], "UniversalStateId bigint, Name string")
    roots = flows.filter(F.col("FlowId") < 2000).select("FlowId")
    return flows, subflows, flow_steps, steps, states, roots


def q_flow_tree(spark, sf_dir):
    from stepwise.plans.flowtree import flow_tree
    configure(spark)
    scratch_folder(spark)
    return flow_tree(*flow_tables(spark, sf_dir))


# ----------------------------------------------------------------------------- J28 J28b J29

def thickness_inputs(spark, sf_dir):
    e, c, o, n = (table(spark, sf_dir, t) for t in ("events", "customer", "orders", "nation"))
    meas = e.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("data_collection_name"),
                    F.when(F.col("value") > 450, "excluded").otherwise("main").alias("flow_name"),
                    F.when(F.col("event_type").isin("click", "view"), "min_t")
                    .when(F.col("event_type").isin("purchase", "signup"), "max_t").otherwise("other").alias("parameter_name"),
                    F.when(F.col("value") < 1, "junk").otherwise(F.col("value").cast("string")).alias("collected_value"),
                    F.col("ts").alias("data_collection_complete_date"), F.lit("L1").alias("manufacturer_lot_number"),
                    F.lit("P1").alias("product_name"))
    blocks = c.select(F.col("c_custkey").alias("id_block"), F.col("c_nationkey").cast("bigint").alias("parent_id_block"))
    layers = c.select(F.col("c_custkey").alias("id_block"), F.col("c_mktsegment").alias("data"))
    recipes = o.select(F.col("o_custkey").alias("id_block"), F.col("o_totalprice").cast("string").alias("recipe_target"),
                       F.col("o_orderdate").alias("timestamp"))
    hist = e.select(F.col("user_id").alias("id_block"),
                    F.when(F.col("value") > 300, "Terminate").otherwise("Move").alias("operation_name"),
                    F.col("event_type").alias("step_name"), F.col("ts").alias("modified_on"))
    dims = n.select(F.col("n_nationkey").cast("bigint").alias("id_block"), (F.col("n_nationkey") + 10).alias("width"),
                    F.when(F.col("n_regionkey") != 0, F.col("n_regionkey") * 10).alias("length"))
    return meas, blocks, layers, recipes, hist, dims


def thickness_demo(spark, sf_dir, **kw):
    from datetime import timedelta

    from stepwise.plans.thickness import thickness_report
    return thickness_report(*thickness_inputs(spark, sf_dir), EVENTS_AS_OF, collection="purchase",
                            exclude_flow="excluded", min_param="min_t", max_param="max_t", cohort_days=90,
                            recent_days=30, offset=timedelta(days=2), step_prefixes=("err", "cl"), rank_width=10, **kw)


def q_thickness_report(spark, sf_dir):
    configure(spark)
    return thickness_demo(spark, sf_dir)


def q_outlier_classes(spark, sf_dir):
    from stepwise.plans.thickness import outlier_class
    configure(spark)
    li = table(spark, sf_dir, "lineitem")
    center = (F.col("l_quantity") - 25) * 5
    spread = F.col("l_discount") * 2000
    x = li.select("l_orderkey", "l_linenumber", "l_partkey", (center - spread / 2).alias("minThick"),
                  (center + spread / 2).alias("maxThick"))
    return x.select("*", outlier_class("minThick", "maxThick", 80, 5).alias("outlier5"),
                    outlier_class("minThick", "maxThick", 80, 3).alias("outlier3"))


def q_chart_marks(spark, sf_dir):
    from stepwise.plans.thickness import chart_marks
    configure(spark)
    scratch_folder(spark)
    return chart_marks(thickness_demo(spark, sf_dir, ordered=False))


def q_thickness_older(spark, sf_dir):
    """J28, older variant: three outlier classes and one more text reading per unit."""
    configure(spark)
    return thickness_demo(spark, sf_dir, ways=3, text_params={"other_text": "other"})


REGISTRY.update({
    "backfill_latest": q_backfill_latest,
    "merge_fill_null": q_merge_fill_null,
    "yield_per_parent": q_yield_per_parent,
    "throughput_report": q_throughput_report,
    "cycle_time_report": q_cycle_time_report,
    "flow_tree": q_flow_tree,
    "thickness_report": q_thickness_report,
    "outlier_classes": q_outlier_classes,
    "chart_marks": q_chart_marks,
})


# ----------------------------------------------------------------------------- operator-level demos

def q_interval_join(spark, sf_dir):
    """Each event meets the purchases of the same user whose 2-day window contains it."""
    from stepwise.operators.joins import interval_join
    configure(spark)
    e = table(spark, sf_dir, "events")
    pts = e.select(F.col("event_id").alias("pid"), F.col("user_id").alias("pk"), "ts")
    iv = e.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("iid"), F.col("user_id").alias("ik"),
        F.timestamp_add("DAY", F.lit(-2), F.col("ts")).alias("s"), F.col("ts").alias("e"))
    return interval_join(pts, iv, [("pk", "ik")], "ts", "s", "e", width=86400).select("pid", "iid")


def q_latest_before(spark, sf_dir):
    """Per purchase and event type, the newest earlier event of the user by id *and* by time.

    The right side's time is shifted by the event value (minutes), so id order and time order
    disagree for some rows and the exact fallback is exercised."""
    from stepwise.operators.joins import latest_before
    configure(spark)
    e = table(spark, sf_dir, "events")
    left = e.filter(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("run_id"),
                                                             F.col("ts").alias("t"))
    right = e.filter(F.col("event_type") != "purchase").select(
        "user_id", "event_type", F.col("event_id").alias("cfg_id"),
        F.timestamp_add("MINUTE", F.round(F.col("value")).cast("int"), F.col("ts")).alias("cfg_t"))
    return latest_before(left, right, by=["user_id"], combos=["event_type"], left_id="run_id", right_id="cfg_id",
                         left_time="t", right_time="cfg_t", width=500, name="last_id").select(
        "run_id", "event_type", "last_id")


def q_any_key_join(spark, sf_dir):
    """Line items whose order key equals the order's key or its customer key."""
    from stepwise.operators.joins import any_key_join
    configure(spark)
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    small = o.select("o_orderkey", "o_custkey")
    return any_key_join(small, li.select("l_orderkey", "l_linenumber", "l_quantity"), ["o_orderkey", "o_custkey"],
                        "l_orderkey").select("o_orderkey", "o_custkey", "l_orderkey", "l_linenumber", "l_quantity")


def q_median_over(spark, sf_dir):
    """Exact median of the extended price per return flag on every line item."""
    from stepwise.operators.ordered import median_over
    configure(spark)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return median_over(li, ["l_returnflag"], "l_extendedprice", width=5000, name="median_price")


def q_median_nan(spark, sf_dir):
    """W09 with NaN among the values (NaN sorts last): median event value per type on every event."""
    from stepwise.operators.ordered import median_over
    configure(spark)
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return median_over(e.select("event_id", "event_type", v.alias("v")), ["event_type"], "v", width=50, name="med").select(
        "event_id", "event_type", "med")


def q_rank_nan(spark, sf_dir):
    """Exact row numbers per user over values with NaN (after every number), ties by event id."""
    from stepwise.operators.ordered import ordered_rank
    configure(spark)
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return ordered_rank(e.select("event_id", "user_id", v.alias("v")), ["user_id"], ["v", "event_id"], width=50, name="rn").select(
        "event_id", "user_id", "rn")


def q_lead_text(spark, sf_dir):
    """W01 with a text order key: the next customer of the nation by name."""
    from stepwise.operators.ordered import shift_within
    configure(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    return shift_within(c, ["c_nationkey"], ["c_name"], ["c_custkey"], offset=1, prefix="next_")


NUMBER_FORMS = ("", "d", "f", "e2", "x", ".", " ")


def q_parse_numbers(spark, sf_dir):
    """Numbers as text with endings that only some parsers take."""
    from stepwise.functions.nullops import safe_number
    configure(spark)
    li = table(spark, sf_dir, "lineitem")
    ending = F.element_at(F.array(*map(F.lit, NUMBER_FORMS)), (F.col("l_orderkey") % len(NUMBER_FORMS) + 1).cast("int"))
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit(".5"), ending)
    return li.select("l_orderkey", "l_linenumber", safe_number(text).alias("number"))


def q_dense_rank_global(spark, sf_dir):
    """DENSE_RANK() OVER (ORDER BY segment, customer key) without a single-partition window."""
    from stepwise.operators.ordered import global_dense_rank
    configure(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return global_dense_rank(c, ["c_mktsegment", "c_custkey"], width=100, name="rank", bucket_col="c_custkey")


def q_lead_lag(spark, sf_dir):
    """Next and previous event value per user in time order."""
    from stepwise.operators.ordered import neighbours
    configure(spark)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return neighbours(e, ["user_id"], ["ts"], ["value"], width=86400, next_prefix="next_", prev_prefix="prev_")


def q_latest_per_key(spark, sf_dir):
    """All line items of each part's newest ship date (ties kept)."""
    from stepwise.operators.latest import latest_per_key
    configure(spark)
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return latest_per_key(li, ["l_partkey"], "l_shipdate")


def q_top_row_per_key(spark, sf_dir):
    """Newest order per customer, ties broken by the larger total price."""
    from stepwise.operators.latest import top_row_per_key
    configure(spark)
    o = table(spark, sf_dir, "orders")
    return top_row_per_key(o, ["o_custkey"], ["o_orderdate"], ["o_totalprice", "o_orderkey"])


def q_pivot_params(spark, sf_dir):
    """Per user, the largest value of each event type as its own column."""
    from stepwise.operators.pivot import pivot_params
    configure(spark)
    e = table(spark, sf_dir, "events")
    return pivot_params(e, ["user_id"], "event_type", "value",
                        [("clicks", "click"), ("views", "view"), ("buys", ["purchase"]), ("other", ["signup", "error"])])


def q_sorted_list(spark, sf_dir):
    """Per order, the sorted list of return flags with their count and quantity total."""
    from stepwise.operators.lists import grouped_sorted_list
    configure(spark)
    li = table(spark, sf_dir, "lineitem")
    return grouped_sorted_list(li, ["l_orderkey"], "l_returnflag", "flags", count_name="n_flags",
                               sums={"qty": "l_quantity"})


def q_not_in_null_aware(spark, sf_dir):
    """Customers whose key is NOT IN the keys of any order (SQL semantics)."""
    from stepwise.operators.joins import anti_null_aware
    configure(spark)
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return anti_null_aware(c.select("c_custkey", "c_name"), o, "c_custkey", "o_custkey")


def q_period_rollup(spark, sf_dir):
    """Event value per type for three look-backs from a single scan."""
    from stepwise.functions.timeops import between_instants
    from stepwise.operators.grids import Period, explode_periods
    configure(spark)
    e = table(spark, sf_dir, "events")
    mem = [(Period(label, i, d), between_instants(e, "ts", EVENTS_AS_OF - timedelta(days=d), EVENTS_AS_OF))
           for i, (label, d) in enumerate([("7d", 7), ("14d", 14), ("30d", 30)])]
    tagged = explode_periods(e, mem)
    return tagged.groupBy("event_type", "period").agg(
        F.round(F.sum("value") / F.max("_divisor"), 6).alias("per_day"), F.count(F.lit(1)).alias("n"))


REGISTRY.update({
    "interval_join": q_interval_join,
    "latest_before": q_latest_before,
    "any_key_join": q_any_key_join,
    "median_over": q_median_over,
    "dense_rank_global": q_dense_rank_global,
    "lead_lag": q_lead_lag,
    "latest_per_key": q_latest_per_key,
    "top_row_per_key": q_top_row_per_key,
    "pivot_params": q_pivot_params,
    "sorted_list": q_sorted_list,
    "not_in_null_aware": q_not_in_null_aware,
    "period_rollup": q_period_rollup,
    "median_nan": q_median_nan,
    "rank_nan": q_rank_nan,
    "lead_text": q_lead_text,
    "parse_numbers": q_parse_numbers,
})


def q_backfill_latest_plain(spark, sf_dir):
    """J20, second instance: the target has no growth-id column; other processes and no location rule."""
    from stepwise.plans.backfill import HISTORY_COLUMNS, backfill_latest
    configure(spark)
    hist = event_history(spark, sf_dir)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    run_blocks = o.select(F.col("o_custkey").alias("id_block"), F.col("o_orderkey").alias("id_run_growth"))
    ids = c.filter(F.col("c_mktsegment") == "MACHINERY").select("c_custkey")
    target = hist.filter(F.col("step_parameter") == "click").select(*HISTORY_COLUMNS)
    return backfill_latest(target, hist, run_blocks, ids, ["ProcA", "ProcB"], with_growth=False)


REGISTRY["backfill_latest_plain"] = q_backfill_latest_plain


# ----------------------------------------------------------------------------- sources and sinks by themselves

def q_inline_offsets(spark, sf_dir):
    """An inline array with offsets, joined to the events of each type."""
    from stepwise.operators.grids import inline_values
    configure(spark)
    kinds = inline_values(spark, ["view", "click", "signup"], "event_type", offset_name="pos")
    e = table(spark, sf_dir, "events")
    return e.join(kinds, "event_type").groupBy("event_type", "pos").agg(F.count(F.lit(1)).alias("n"))


def q_sheet_read(spark, sf_dir):
    """Customers written as an untyped sheet with repeated header rows, read back without them."""
    from stepwise.sources.tables import read_sheet
    configure(spark)
    path = own_folder(spark, "stepwise_sheet")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("a"), F.col("c_name").alias("b"))
    head = c.limit(1).select(F.lit("Item").alias("a"), F.lit("Name").alias("b"))
    head.union(c).write.csv(path)
    return read_sheet(spark, path, 2)


def q_append_rows(spark, sf_dir):
    """Nations appended to a table of regions by column position."""
    from stepwise.sources.sinks import append_rows
    from stepwise.sources.tables import read_table
    configure(spark)
    path = own_folder(spark, "stepwise_append")
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    append_rows(r.select(F.col("r_regionkey").cast("long"), "r_name"), path, ["id", "name"])
    append_rows(n.select((F.col("n_nationkey") + 100).cast("long"), "n_name"), path, ["id", "name"])
    return read_table(spark, path)


def q_replace_table(spark, sf_dir):
    """A table replaced by a rewrite of itself."""
    from stepwise.sources.sinks import write_replace
    from stepwise.sources.tables import read_table
    configure(spark)
    path = own_folder(spark, "stepwise_replace")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").write.parquet(path)
    write_replace(read_table(spark, path).withColumn("s_acctbal", F.col("s_acctbal") * 2), path)
    return read_table(spark, path)


EXPLICIT_DIMENSION_ROWS = [("s7", "low", "Prep", 41, "Block", "1x1"), ("s8", "high", "Finish", 42, "Plate", "2x2")]


def q_append_transitions(spark, sf_dir):
    """J27, first form: literal transition rows with their own step order and product."""
    from stepwise.plans.audits import append_dimension
    configure(spark)
    e = table(spark, sf_dir, "events")
    target = e.select(F.col("event_type").alias("step_name"), F.when(F.col("value") > 100, "high").otherwise("low").alias("step_name_next"),
                      F.lit("seg").alias("segment_name"), F.lit(1).alias("step_order"), F.lit("Block").alias("unit"),
                      F.lit("1x1").alias("master_product")).distinct()
    return append_dimension(spark, target, EXPLICIT_DIMENSION_ROWS, "step_name string, step_name_next string, segment_name string, "
                            "step_order int, unit string, master_product string")


REGISTRY.update({
    "inline_offsets": q_inline_offsets,
    "sheet_read": q_sheet_read,
    "append_rows": q_append_rows,
    "replace_table": q_replace_table,
    "append_transitions": q_append_transitions,
    "thickness_older": q_thickness_older,
})


# ----------------------------------------------------------------------------- versioned tables

def q_backfill_versions(spark, sf_dir):
    """J20 on a stored table: the same content as ``backfill_latest``, with only the touched files rewritten."""
    from stepwise.plans.backfill import HISTORY_COLUMNS, write_backfill_latest
    from stepwise.sources.versions import read_version
    configure(spark)
    path = own_folder(spark, "stepwise_backfill")
    hist = event_history(spark, sf_dir)
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    run_blocks = o.select(F.col("o_custkey").alias("id_block"), F.col("o_orderkey").alias("id_run_growth"))
    ids = c.filter(F.col("c_mktsegment") == "AUTOMOBILE").select("c_custkey")
    target = hist.filter(F.col("step_parameter") == "view").select(*HISTORY_COLUMNS, F.lit(-1).cast("bigint").alias("last_growth"))
    target.repartitionByRange("id_block").write.parquet(path)
    write_backfill_latest(spark, path, hist, run_blocks, ids, ["ProcA"], exclude_location="WS")
    return read_version(spark, path)


def q_fill_null_versions(spark, sf_dir):
    """J21 on a stored table: the same content as ``merge_fill_null``."""
    from stepwise.plans.backfill import write_fill_null
    from stepwise.sources.versions import read_version
    configure(spark)
    path = own_folder(spark, "stepwise_fill")
    c, e = table(spark, sf_dir, "customer"), table(spark, sf_dir, "events")
    c.select(F.col("c_custkey").alias("id_block"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("longest_dim")).repartitionByRange(
        "id_block").write.parquet(path)
    hist = e.select(F.col("user_id").alias("id_block"), F.col("event_id").alias("id_run"), F.col("event_type").alias("step_parameter"),
                    F.when(F.col("value") < 5, "bad").otherwise(F.col("value").cast("string")).alias("data"))
    write_fill_null(spark, path, hist, "purchase", "longest_dim")
    return read_version(spark, path)


def q_delete_versions(spark, sf_dir):
    """S09/S07 on a stored table: orders of a few customers deleted, then the table replaced by a rewrite of itself."""
    from stepwise.sources.versions import delete_rows, read_version, replace_table
    configure(spark)
    path = own_folder(spark, "stepwise_delete")
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o.select("o_orderkey", "o_custkey", "o_totalprice").repartitionByRange("o_custkey").write.parquet(path)
    delete_rows(spark, path, c.filter(F.col("c_acctbal") < -900).select("c_custkey"), "o_custkey")
    replace_table(read_version(spark, path).withColumn("o_totalprice", F.col("o_totalprice") * 2), path)
    return read_version(spark, path)


REGISTRY.update({
    "backfill_versions": q_backfill_versions,
    "fill_null_versions": q_fill_null_versions,
    "delete_versions": q_delete_versions,
})
