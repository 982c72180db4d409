"""Reference process profile: the fixed values the original reports were run with.

Every job takes these as parameters; this module only collects the values the original scripts
used so the same reports can be reproduced. People's names, unit-id lists and external-system ids
are deliberately absent (they are per-run inputs, not process definitions).
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from stepwise.functions.rules import Alias
from stepwise.operators.grids import inline_rows

# ----------------------------------------------------------------------------- fixed values
# Time zone of the plant reports.
PLANT_TZ = "America/Los_Angeles"

# Equipment-configuration parameter aliases (J07), in the order they are tested.
EQUIPMENT_ALIASES = [
    Alias("HardwarePlatform", values=["Hardware Platform", "HardwarePlatformGeneration"]),
    Alias("HardwarePlatform", like=["Hardware%Platform%"]),
    Alias("Microwave", values=["Microwave", "Cabinet Type"]),
    Alias("Pyro Motor Configuration", values=["Pyro Motor Configuration", "Pyro motor configuration"]),
    Alias("Water Flow Meter", values=["Water Flow Meter", "Water Flow Sensor"]),
    Alias("PLC Configuration", values=["PLC Configuration", "PLC Version"]),
    Alias("Centering Collar", values=["Centering Collar", "Coax Collar"]),
    Alias("Camera", values=["Camera", "Camera Configurations"]),
]

# Equipment-configuration output columns (J07), as (column, parameter name).
EQUIPMENT_COLUMNS = [
    ("nozzle", "Nozzle"), ("hardlines", "Hardlines"), ("microwave", "Microwave"), ("regulator", "Regulator"),
    ("hardware_platform", "HardwarePlatform"), ("end_cap", "End Cap"),
    ("pyro_motor_configuration", "Pyro Motor Configuration"), ("chamber", "Chamber"), ("door_knob", "Door Knob"),
    ("turbo", "Turbo"), ("clamp_ring", "Clamp Ring"), ("water_flow_meter", "Water Flow Meter"),
    ("inner_coax_coating", "Inner Coax Coating"), ("stage_coating", "Stage coating"), ("magnetron", "Magnetron"),
    ("backing", "Backing"), ("water_supply_return_bulkhead_fittings", "Water Supply & Return Bulkhead Fittings"),
    ("plc_configuration", "PLC Configuration"), ("cooling_plate", "Cooling Plate"), ("miter_bend", "Miter Bend"),
    ("gfci", "GFCIs"), ("exhaust_dp_sensor", "Exhaust DP Sensor"), ("centering_collar", "Centering Collar"),
    ("camera", "Camera"), ("MaxPower", "MaxPower"), ("PSU1", "PSU1"), ("PSU2", "PSU2"), ("PSU3", "PSU3"),
    ("PSU4", "PSU4"), ("octopus", "Octopus"), ("octopus_Oring_grease", "Octopus O-ring Grease"),
    ("particulate_filters", "Particulate Filters"), ("stage_Oring_grease", "Stage O-ring Grease"),
]

# Segment transitions of the back-end flow (J24 throughput), (step, next step, segment, unit).
THROUGHPUT_TRANSITIONS = [
    ("702038", "702040", "Block Prep", "Block"),
    ("702040", "704020", "RIM", "Block"),
    ("704050", "704060", "Singulation|parent", "Block"),
    ("704070", "706015", "Singulation|child", "Plate"),
    ("706025", "710010", "Basic Surfin", "Plate"),
    ("710035", "711010", "Finish", "Plate"),
    ("710035", "712030", "Finish", "Plate"),
]

# The same transitions as used by the cycle-time report (J25); one unit differs.
CYCLE_TRANSITIONS = [
    ("702038", "702040", "Block Prep", "Block"),
    ("702040", "704020", "RIM", "Block"),
    ("704050", "704060", "Singulation|parent", "Plate"),
    ("704070", "706015", "Singulation|child", "Plate"),
    ("706025", "710010", "Basic Surfin", "Plate"),
    ("710035", "711010", "Finish", "Plate"),
    ("710035", "712030", "Finish", "Plate"),
]

# Steps of each segment with their list position (J25), in list order.
SEGMENT_STEPS = [
    ("702005", "Block Prep"), ("702020", "Block Prep"), ("702030", "Block Prep"), ("702033", "Block Prep"),
    ("702035", "Block Prep"), ("702038", "Block Prep"), ("702040", "RIM"),
    ("704020", "Singulation|parent"), ("704035", "Singulation|parent"), ("704040", "Singulation|parent"),
    ("704050", "Singulation|parent"),
    ("704060", "Singulation|child"), ("704066", "Singulation|child"), ("704070", "Singulation|child"),
    ("706015", "Basic Surfin"), ("706020", "Basic Surfin"), ("706025", "Basic Surfin"),
    ("710010", "Finish"), ("710020", "Finish"), ("710030", "Finish"), ("710035", "Finish"),
]

# Back-end flow name, test material and the excluded-flow of the step-log reports.
BACK_END_FLOW = "BE Flow"
TEST_MATERIAL = "Software Test"
PARENT_SEGMENT = "Singulation|parent"

# Cycle-time segment refinement (J03): {segment: ([(step codes, label)], otherwise)} and renames.
CORING_SPLITS = {
    "Shave/Trim": ([(["306010"], "Trim"), (["306006"], "Shave")], "Shave/Trim Buffer and Char"),
    "TDL": ([(["304020"], "TDL"), (["304030", "304040", "304050", "304060", "304062"], "Split")], "TDL/Split"),
}
CORING_RENAMES = {"Coring": "Core", "TDL": "TDL", "Split": "Split", "TDL/Split": "TDL/Split", "Trim": "Trim",
                  "Shave": "Shave", "Shave/Trim Buffer and Char": "Trim / Shave"}

# Growth-event thresholds (J12): label rules in priority order and the keep filter.
EVENT_LABELS = [("range_incident_power", 0.8, "incident_power_event"),
                ("range_chamber_pressure", 1.0, "chamber_pressure_event"),
                ("range_reflected_power", 6800.0, "reflected_power_event")]
EVENT_DEFAULT_LABEL = "vsp_counter_event"
EVENT_UPPER_LIMITS = [("range_ppb_n2", 50.0), ("range_curtain_h2", 100.0), ("range_process_ch4", 10.0),
                      ("range_process_h2", 50.0), ("range_mw_setpoint", 4.0), ("range_pressure_setpoint", 4.0)]

# Label-audit reasons (J13) — change-notice date and hours-to-end limit.
ECN_DATE = "2024-09-30"
CLOSE_TO_END_HOURS = 4.0

# Thickness characterisation.
THICKNESS_COLLECTION = "TDL/Despike FRT_CWL"
THICKNESS_EXCLUDED_FLOW = "TDL-TA_Master V0A"
THICKNESS_MIN_PARAM = "min_thickness_despike_filtered"
THICKNESS_MAX_PARAM = "max_thickness_despike_filtered"
SCRAP_STEP_PREFIXES = ("304", "344", "704")


# ----------------------------------------------------------------------------- helpers

def event_rules() -> tuple[list[tuple[Column, str]], str, Column]:
    """(label rules, default label, keep filter) of the growth-event classification."""
    rules = [(F.col(c) > v, label) for c, v, label in EVENT_LABELS]
    keep = ((F.col("range_incident_power") > 0.8) & (F.col("range_reflected_power") > 6800)) | (F.col("range_chamber_pressure") > 1)
    for c, v in EVENT_UPPER_LIMITS:
        keep = keep & (F.col(c) < v)
    return rules, EVENT_DEFAULT_LABEL, keep


def audit_reasons() -> list[tuple[Column, str]]:
    """Label-audit reasons (J13) in priority order."""
    return [(F.col("end_time") < F.lit(ECN_DATE).cast("timestamp"), "Before ECN"),
            (F.col("hour_til_end") < CLOSE_TO_END_HOURS, "close to end"),
            (F.col("final_clean_vol_cm3").isNull(), "No Charx"),
            (F.col("loading_purpose") != "Production", "Not Production"),
            (F.col("custom_workflow").isNotNull(), "Flagged but missed")]


def transitions(spark: SparkSession, rows=THROUGHPUT_TRANSITIONS):
    return inline_rows(spark, rows, "step_name string, step_name_next string, segment_name string, unit string")


def segment_steps(spark: SparkSession, rows=SEGMENT_STEPS):
    return inline_rows(spark, [(s, n, i) for i, (s, n) in enumerate(rows)], "step_name string, segment_name string, pos int")
