"""Text helpers: code rewrites, splits, T-SQL concatenation and padding, number formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CARRIAGE_RETURN = "\r"  # T-SQL CHAR(13)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rewrite_codes(c, rewrites: Sequence[tuple[str, str]]) -> Column:
    """Nested ``REGEXP_REPLACE``: rewrites apply in order, each to the previous result."""
    out = _c(c)
    for pattern, replacement in rewrites:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def split_first(c, sep: str) -> Column:
    """``SPLIT(s, sep)[0]`` with a literal (not regex) separator."""
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def tsql_concat(*cols) -> Column:
    """T-SQL ``CONCAT``: nulls read as empty strings."""
    return F.concat_ws("", *[_c(c).cast("string") for c in cols])


def tsql_plus(*cols) -> Column:
    """T-SQL ``a + b`` on strings: null if any part is null."""
    return F.concat(*[_c(c).cast("string") for c in cols])


def pad_position(c, width: int = 3, form: str = "plus") -> Column:
    """``REPLICATE('0', width - LEN(RTRIM(x))) <op> RTRIM(x)``.

    ``REPLICATE`` with a negative count is null. With ``form='plus'`` (``+``) a value longer than
    ``width`` therefore gives null; with ``form='concat'`` (``CONCAT``) the pad drops out and the
    trimmed value is kept whole. Values are never cut.
    """
    t = F.rtrim(_c(c).cast("string"))
    n = F.length(t)
    padded = F.concat(F.repeat(F.lit("0"), F.lit(width) - n), t)
    if form == "plus":
        return F.when(n <= width, padded)
    if form == "concat":
        return F.when(n <= width, padded).otherwise(t)
    raise ValueError(f"unknown form {form!r}")


def tsql_default_width(c, width: int = 30) -> Column:
    """``CAST(x AS VARCHAR)`` without a length keeps the first 30 characters."""
    return F.substring(_c(c).cast("string"), 1, width)


def number_text(c, digits: int = 2) -> Column:
    """``str(round(x, digits))``; Spark rounds half-up on the decimal form (documented difference)."""
    return F.round(_c(c), digits).cast("string")
