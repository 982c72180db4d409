"""Step-log jobs: delays between steps, throughput counts, units seen, sequence gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.nullops import distinct_from
from stepwise.functions.text import rewrite_codes
from stepwise.functions.timeops import DEFAULT_TZ, in_local_days, whole_units
from stepwise.operators.ordered import shift_within

# Step-code normalisation used by the throughput count (fixed values of the reference process).
LEGACY_STEP_REWRITES = [(r"^403", "303"), (r"^404", "304")]


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def _flow(log: DataFrame, flow, flow_col: str) -> DataFrame:
    return log if flow is None else log.filter(F.col(flow_col) == F.lit(flow))


def step_delay(log: DataFrame, done_step, ref_step, as_of, *, days: float = 15, flow: str | None = None,
               tz: str = DEFAULT_TZ, id_col: str = "id_block", step_col: str = "step_name",
               end_col: str = "end_time", flow_col: str = "flow_name_in", ref_name: str = "cored_time",
               delay_name: str = "time_delay") -> DataFrame:
    """Units finishing ``done_step`` in the local-day window, left-joined to all their
    ``ref_step`` finishes (no window on that side, so it may fan out); delay in fractional days
    from whole minutes (``TIMESTAMP_DIFF(end, ref, MINUTE)/60/24``)."""
    base = _flow(log, flow, flow_col)
    done = base.filter(in_local_days(log, end_col, as_of, days, tz) & F.col(step_col).isin(_as_list(done_step)))
    done = done.select(id_col, end_col)
    ref = base.filter(F.col(step_col).isin(_as_list(ref_step))).select(id_col, F.col(end_col).alias(ref_name))
    out = done.join(ref, id_col, "left")
    return out.withColumn(delay_name, whole_units(end_col, ref_name, "MINUTE") / 60 / 24)


def completed_count(log: DataFrame, steps, as_of, *, days: float = 5, rewrites=LEGACY_STEP_REWRITES,
                    flow: str | None = None, tz: str = DEFAULT_TZ, id_col: str = "id_block",
                    step_col: str = "step_name", end_col: str = "end_time", flow_col: str = "flow_name_in",
                    name: str = "completed_count") -> DataFrame:
    """``COUNT(id)`` of rows whose rewritten step code is in ``steps`` in the local-day window."""
    base = _flow(log, flow, flow_col)
    norm = base.filter(in_local_days(log, end_col, as_of, days, tz)).select(
        id_col, rewrite_codes(step_col, rewrites).alias(step_col))
    return norm.filter(F.col(step_col).isin(_as_list(steps))).agg(F.count(id_col).alias(name))


def units_at_step(log: DataFrame, steps, as_of, *, days: float = 15, flow: str | None = None,
                  tz: str = DEFAULT_TZ, id_col: str = "id_block", step_col: str = "step_name",
                  end_col: str = "end_time", flow_col: str = "flow_name_in") -> DataFrame:
    """Ids of rows of a flow that ended one of ``steps`` in the local-day window."""
    base = _flow(log, flow, flow_col)
    return base.filter(in_local_days(log, end_col, as_of, days, tz) & F.col(step_col).isin(_as_list(steps))).select(id_col)


def sequence_gaps(log: DataFrame, *, key: str = "id_block", start: str = "start_time", end: str = "end_time",
                  unit: str = "HOUR", width=7 * 86400) -> DataFrame:
    """Per unit, the next row's start (by end time) against this row's end.

    Zero-length rows are removed *before* the neighbour lookup; rows where the two differ and
    neither is null are kept, with the whole-``unit`` gap. The lookup is skew-safe
    (``shift_within`` buckets the end time by ``width`` seconds).
    """
    rows = log.filter(F.col(end) != F.col(start)).select(key, F.col(end).alias("this_end"), F.col(start).alias("_start"))
    nxt = shift_within(rows, [key], ["this_end"], ["_start"], offset=1, width=width, prefix="next")
    nxt = nxt.drop("_start")
    out = nxt.filter(distinct_from("next_start", "this_end") & F.col("this_end").isNotNull()
                     & F.col("next_start").isNotNull())
    return out.withColumn("time_diff", whole_units("next_start", "this_end", unit)).orderBy(key, "this_end")
