"""stepwise: manufacturing-traceability analytics as Spark DataFrame transformations.

Layout
------
functions/  column-level helpers (time zones, null rules, text, ordered rules)
operators/  relational building blocks (skew-safe ordered scans, joins, latest-per-key, pivots, grids, trees)
sources/    readers and table-maintenance sinks (append, keyed replace, merge, staged overwrite)
plans/      the end-user jobs (reports, audits, backfills, imports)
streaming/  incremental (micro-batch) driver for the run-verification load

Every job takes DataFrames plus an explicit ``as_of`` instant; nothing reads the wall clock.
All timestamp columns are treated as UTC instants; ``stepwise.session.configure`` pins the
session time zone to UTC so TIMESTAMP and TIMESTAMP_NTZ values agree.
"""

from stepwise.session import configure, get_session, checkpoint_dir  # noqa: F401

__all__ = ["configure", "get_session", "checkpoint_dir"]
