"""Time-zone, window-bound and calendar helpers.

Two flavours:

* **Bounds** (``local_midnight_of`` …) are computed once in Python from the explicit ``as_of`` and
  emitted as typed literals, so Catalyst folds them and Parquet receives plain range predicates
  (``PushedFilters``). Never wrap the fact column in a function to compare it with a bound.
* **Column functions** (``local_wall`` …) convert per row, for values that are reported.

Convention: every timestamp column is a UTC instant. TIMESTAMP_NTZ columns hold UTC wall-clock
values; with the session time zone pinned to UTC (``stepwise.session.configure``) both types agree.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

DEFAULT_TZ = "America/Los_Angeles"


# ----------------------------------------------------------------------------- python-side bounds

def as_utc(as_of) -> datetime:
    """Normalise ``as_of`` (datetime or ISO string) to a naive UTC datetime."""
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if isinstance(as_of, date) and not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def local_midnight_of(as_of, tz: str = DEFAULT_TZ, days_back: float = 0) -> datetime:
    """Instant (naive UTC) of local midnight of the local day holding ``as_of - days_back``.

    The subtraction happens on the instant *before* truncation (``TRUNC(now - n day, DAY, tz)``).
    """
    t = as_utc(as_of) - timedelta(days=days_back)
    z = ZoneInfo(tz)
    local = t.replace(tzinfo=timezone.utc).astimezone(z)
    return datetime(local.year, local.month, local.day, tzinfo=z).astimezone(timezone.utc).replace(tzinfo=None)


def local_wall_of(as_of, tz: str = DEFAULT_TZ) -> datetime:
    """Local wall-clock reading (naive) of an instant."""
    return as_utc(as_of).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def local_today(as_of, tz: str = DEFAULT_TZ) -> date:
    """``CURRENT_DATE(tz)`` at ``as_of``."""
    return local_wall_of(as_of, tz).date()


def local_day_floor(as_of, tz: str = DEFAULT_TZ, days_back: float = 0) -> datetime:
    """``TIMESTAMP_TRUNC(DATETIME(as_of - n day, tz), DAY)``: a local wall-clock midnight (naive)."""
    w = local_wall_of(as_utc(as_of) - timedelta(days=days_back), tz)
    return datetime(w.year, w.month, w.day)


def instant_of_local_date(d: date, tz: str = DEFAULT_TZ) -> datetime:
    """Naive-UTC instant of local midnight starting calendar day ``d``."""
    return datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(tz)).astimezone(timezone.utc).replace(tzinfo=None)


# ----------------------------------------------------------------------------- literals

def ts_literal(value: datetime, data_type: DataType | None = None) -> Column:
    """A foldable timestamp literal of the given type (NTZ by default)."""
    s = as_utc(value).strftime("%Y-%m-%d %H:%M:%S.%f")
    if data_type is None or isinstance(data_type, TimestampNTZType):
        return F.lit(s).cast("timestamp_ntz")
    return F.lit(s + "Z").cast("timestamp")


def col_literal(df: DataFrame, col: str, value: datetime) -> Column:
    """Timestamp literal typed like ``df[col]`` so the comparison stays a bare-column predicate."""
    return ts_literal(value, df.schema[col].dataType)


_RULE = "date_partition"  # key in a timestamp column's metadata


def with_date_partition(df: DataFrame, ts_col: str, date_col: str, zone: str = "UTC") -> DataFrame:
    """``df``, told that it is partitioned by ``date_col``, the date of the instant ``ts_col`` in ``zone``.

    Every range predicate on ``ts_col`` of this DataFrame (and of what is selected, filtered or joined from it while
    both columns are there) then also bounds ``date_col`` with literal dates, so the scan prunes whole partition
    directories, not just Parquet row groups. The rule is metadata of the column: other tables with columns of these names
    are not touched, and each may have another zone.
    """
    if date_col not in df.columns:
        raise ValueError(f"no column {date_col}")
    return df.withMetadata(ts_col, {**df.schema[ts_col].metadata, _RULE: {"column": date_col, "zone": zone}})


def _partition_bounds(df: DataFrame, col: str, lo: datetime | None, hi: datetime | None) -> list[Column]:
    """Bounds of the date column that ``with_date_partition`` names, if the table still has it."""
    rule = df.schema[col].metadata.get(_RULE)
    if not rule or rule["column"] not in df.columns:
        return []
    day = lambda t: F.lit(as_utc(t).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(rule["zone"])).date())
    part = F.col(rule["column"])
    return ([part >= day(lo)] if lo is not None else []) + ([part <= day(hi)] if hi is not None else [])


def between_instants(df: DataFrame, col: str, lo: datetime | None, hi: datetime | None,
                     lo_inclusive: bool = True, hi_inclusive: bool = True) -> Column:
    """Range predicate on a bare column with literal bounds (pushed to the scan).

    When ``df`` carries a rule for ``col`` (``with_date_partition``), the partition column is bounded too
    (partition pruning).
    """
    c = F.col(col)
    conds = _partition_bounds(df, col, lo, hi)
    if lo is not None:
        b = col_literal(df, col, lo)
        conds.append(c >= b if lo_inclusive else c > b)
    if hi is not None:
        b = col_literal(df, col, hi)
        conds.append(c <= b if hi_inclusive else c < b)
    out = F.lit(True)
    for x in conds:
        out = out & x
    return out


def in_local_days(df: DataFrame, col: str, as_of, days: float, tz: str = DEFAULT_TZ) -> Column:
    """``col BETWEEN TRUNC(as_of - days, DAY, tz) AND TRUNC(as_of, DAY, tz)`` (both ends included)."""
    return between_instants(df, col, local_midnight_of(as_of, tz, days), local_midnight_of(as_of, tz, 0))


def in_local_dates(df: DataFrame, col: str, as_of, days: int, tz: str = DEFAULT_TZ) -> Column:
    """``DATE(col, tz) >= CURRENT_DATE(tz) - days AND DATE(col, tz) < CURRENT_DATE(tz)``, as instants."""
    today = local_today(as_of, tz)
    lo = instant_of_local_date(today - timedelta(days=days), tz)
    hi = instant_of_local_date(today, tz)
    return between_instants(df, col, lo, hi, True, False)


# ----------------------------------------------------------------------------- column functions

def _ntz(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


def local_wall(c, tz: str = DEFAULT_TZ) -> Column:
    """``DATETIME(ts, tz)``: local wall clock as TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _ntz(c))


def local_date(c, tz: str = DEFAULT_TZ) -> Column:
    """``DATE(ts, tz)``."""
    return F.to_date(local_wall(c, tz))


def local_day_start(c, tz: str = DEFAULT_TZ) -> Column:
    """``TIMESTAMP_TRUNC(DATETIME(ts, tz), DAY)`` as TIMESTAMP_NTZ wall clock."""
    return F.to_date(local_wall(c, tz)).cast("timestamp_ntz")


def local_midnight(c, tz: str = DEFAULT_TZ) -> Column:
    """``TIMESTAMP_TRUNC(ts, DAY, tz)``: the instant (NTZ, UTC) of local midnight."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local_day_start(c, tz))


def instant_of(date_col, tz: str = DEFAULT_TZ) -> Column:
    """``TIMESTAMP(date, tz)``: instant (NTZ, UTC) of local midnight of a DATE."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), d.cast("timestamp_ntz"))


def sunday_week(c) -> Column:
    """``TIMESTAMP_TRUNC(ts, WEEK)``: midnight of the Sunday starting the week (UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    d = F.to_date(c)
    return F.date_sub(d, F.dayofweek(d) - 1).cast("timestamp_ntz")


def year_week_u(c) -> Column:
    """``FORMAT_TIMESTAMP('%Y-%U', c)``: year and Sunday-based week number 00-53."""
    c = F.col(c) if isinstance(c, str) else c
    d = F.to_date(c)
    wk = F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")
    return F.concat(F.date_format(d, "yyyy"), F.lit("-"), F.lpad(wk.cast("string"), 2, "0"))


def whole_units(later, earlier, unit: str) -> Column:
    """``TIMESTAMP_DIFF(later, earlier, unit)``: whole elapsed units, truncated toward zero."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return F.timestamp_diff(unit.upper(), _ntz(earlier), _ntz(later))


def hours_between(later, earlier) -> Column:
    """``(UNIX_SECONDS(later) - UNIX_SECONDS(earlier)) / 3600`` (whole seconds, real division)."""
    later = F.col(later) if isinstance(later, str) else later
    earlier = F.col(earlier) if isinstance(earlier, str) else earlier
    return (F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))) / 3600


def shift(c, amount, unit: str = "SECOND") -> Column:
    """``ts + INTERVAL amount unit`` where amount may be a column (whole units)."""
    c = F.col(c) if isinstance(c, str) else c
    amt = amount if isinstance(amount, Column) else F.lit(amount)
    return F.timestamp_add(unit.upper(), amt, c)


def parse_us_date(c) -> Column:
    """``SAFE.PARSE_DATE('%m/%d/%y', s)``: unparsable text gives null; two-digit years 69-99 are 19xx."""
    c = F.col(c) if isinstance(c, str) else c
    d = F.to_date(F.try_to_timestamp(c, F.lit("M/d/yy")))
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
