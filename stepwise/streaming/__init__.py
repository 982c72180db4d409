"""Structured Streaming drivers (incremental loads)."""

from stepwise.streaming.incremental import run_end_time_check, start_end_time_check  # noqa: F401
