"""Readers and sinks."""

from stepwise.sources.sinks import (  # noqa: F401
    align, append_rows, delete_keys, merge_update, only_new, replace_keys, write_replace,
)
from stepwise.sources.tables import read_jdbc, read_shards, read_sheet, read_table, write_shards  # noqa: F401
from stepwise.sources.versions import (  # noqa: F401
    TableChanged, delete_rows, drop_unreferenced, merge_rows, read_version, replace_rows, replace_table,
)
