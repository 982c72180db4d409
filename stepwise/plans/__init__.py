"""End-user jobs."""

from stepwise.plans.audits import append_dimension, audit_absent, tray_shipments, work_order_requests  # noqa: F401
from stepwise.plans.backfill import (  # noqa: F401
    backfill_latest, latest_measurements, merge_fill_null, yield_per_parent,
)
from stepwise.plans.cycle import segment_cycle_time, shipped_cohort  # noqa: F401
from stepwise.plans.flowtree import flow_tree  # noqa: F401
from stepwise.plans.imports import add_struct_field, document_locations, import_sheet, resolve_people  # noqa: F401
from stepwise.plans.reports import cycle_time_report, throughput_report  # noqa: F401
from stepwise.plans.runs import (  # noqa: F401
    change_impact, classify_events, config_at_run, flag_review, label_audit, last_reading_per_run, measure_over,
    runs_missing_metric,
)
from stepwise.plans.steps import completed_count, sequence_gaps, step_delay, units_at_step  # noqa: F401
from stepwise.plans.thickness import chart_marks, facet_order, outlier_class, thickness_report  # noqa: F401
