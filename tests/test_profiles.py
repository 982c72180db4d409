from datetime import datetime

from pyspark.sql import functions as F

from stepwise.plans.profiles import EQUIPMENT_ALIASES, EQUIPMENT_COLUMNS, event_rules, segment_steps, transitions
from stepwise.plans.runs import classify_events, config_at_run


def test_equipment_profile_pivot(spark):
    t = datetime(2025, 1, 1)
    runs = spark.createDataFrame([(500, 100, 7, "R7", datetime(2025, 1, 10))],
                                 "id_run_growth long, id_growing_run long, id_station long, station_name string, start_time timestamp_ntz")
    cfg = spark.createDataFrame([
        (90, 7, t, "s", "HardwarePlatformGeneration", "Gen8"),
        (95, 7, t, "s", "Cabinet Type", "MW-2"),
        (96, 7, t, "s", "Hardware  Platform x", "Gen9"),   # LIKE rule, newer -> wins for HardwarePlatform
        (99, 7, datetime(2025, 2, 1), "s", "Nozzle", "N1"),  # starts after the run -> not in force
        (98, 7, t, "s", "Nozzle", "N0"),
    ], "id_run long, id_station long, start_time timestamp_ntz, step_name string, step_parameter string, step_data string")
    out = config_at_run(runs, cfg, EQUIPMENT_COLUMNS, aliases=EQUIPMENT_ALIASES, width=10).first()
    assert out.hardware_platform == "Gen9" and out.microwave == "MW-2" and out.nozzle == "N0"
    assert len(out) == 3 + 33


def test_event_profile_rules(spark):
    rules, default, keep = event_rules()
    ge = spark.createDataFrame([("1", datetime(2025, 1, 3), 0.9, 7000.0, 0.5, 10.0, 50.0, 5.0, 10.0, 1.0, 1.0)],
                               "id_run_growth string, timestamp timestamp_ntz, range_incident_power double, "
                               "range_reflected_power double, range_chamber_pressure double, range_ppb_n2 double, "
                               "range_curtain_h2 double, range_process_ch4 double, range_process_h2 double, "
                               "range_mw_setpoint double, range_pressure_setpoint double")
    runs = spark.createDataFrame([(1, datetime(2025, 1, 1), datetime(2025, 1, 5), "Production")],
                                 "id_run_growth long, start_time timestamp_ntz, end_time timestamp_ntz, loading_purpose string")
    r = classify_events(ge, runs, rules, default, keep).first()
    assert r.event_type == "incident_power_event" and r.hour_since_start == 48.0


def test_profile_dimensions(spark):
    assert transitions(spark).count() == 7
    steps = segment_steps(spark).collect()
    assert steps[0].pos == 0 and steps[-1].step_name == "710035"
