"""Column-level helpers."""

from stepwise.functions.nullops import (  # noqa: F401
    distinct_from, nonzero_or, safe_number, strict_greatest, strict_least,
)
from stepwise.functions.rules import Alias, alias_values, canonicalise, classify  # noqa: F401
from stepwise.functions.text import (  # noqa: F401
    CARRIAGE_RETURN, number_text, pad_position, rewrite_codes, split_first, tsql_concat,
    tsql_default_width, tsql_plus,
)
from stepwise.functions.timeops import (  # noqa: F401
    DEFAULT_TZ, between_instants, hours_between, in_local_dates, in_local_days, instant_of,
    local_date, local_day_floor, local_day_start, local_midnight, local_midnight_of, local_today,
    local_wall, local_wall_of, parse_us_date, shift, sunday_week, ts_literal, whole_units, with_date_partition,
    year_week_u,
)
