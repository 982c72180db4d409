"""Null-sensitive scalar rules (warehouse semantics that differ from Spark defaults)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_least(*cols) -> Column:
    """``LEAST`` that is null when any input is null (Spark's ``least`` skips nulls)."""
    cs = [_c(c) for c in cols]
    any_null = F.lit(False)
    for c in cs:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.least(*cs))


def strict_greatest(*cols) -> Column:
    """``GREATEST`` that is null when any input is null."""
    cs = [_c(c) for c in cols]
    any_null = F.lit(False)
    for c in cs:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.greatest(*cs))


NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?|nan))\s*$"


def safe_number(c, to: str = "double") -> Column:
    """``SAFE_CAST(x AS FLOAT64)`` / ``pd.to_numeric(errors='coerce')``: unparsable text becomes null.

    The pattern keeps out what the JVM's parser takes besides numbers (``1d``, ``2.5f``).
    """
    text = _c(c).cast("string")
    return F.when(text.rlike(NUMBER), _c(c).try_cast(to))


def distinct_from(a, b) -> Column:
    """``a IS DISTINCT FROM b``."""
    return ~_c(a).eqNullSafe(_c(b))


def nonzero_or(c, default) -> Column:
    """``IF(c != 0, c, default)``: null and zero both fall to the default."""
    c = _c(c)
    return F.when(c != 0, c).otherwise(F.lit(default))


def not_equal_keep_null_out(c, value) -> Column:
    """``c != value`` as a filter: rows where ``c`` is null are dropped, as in SQL."""
    return _c(c) != F.lit(value)
