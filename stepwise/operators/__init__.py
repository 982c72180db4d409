"""Relational building blocks."""

from stepwise.operators.dyadic import LastSmaller, cover, pieces, with_ancestors  # noqa: F401
from stepwise.operators.grids import (  # noqa: F401
    Period, explode_periods, inline_rows, inline_values, numbered, ordered_dim, per_day, rank_by_first, report_grid,
    union_sources,
)
from stepwise.operators.joins import (  # noqa: F401
    any_key_join, anti_null_aware, explode_list, full_join_coalesce, hop, in_ids, interval_join,
    join_back, join_distinct, key_frame, latest_before, offset_join, semi, with_parent,
)
from stepwise.operators.latest import first_per_key, latest_per_key, max_per_key, top_row_per_key  # noqa: F401
from stepwise.operators.ordered import (  # noqa: F401
    delta_from_prev, global_dense_rank, median_over, neighbours, next_value, order_bucket, ordered_rank, positions,
    prev_value, running_max_before, shift_within, splitters, with_global_max,
)
from stepwise.operators.pivot import pivot_params  # noqa: F401
from stepwise.operators.lists import grouped_sorted_list  # noqa: F401
from stepwise.operators.tree import materialize, walk_levels, walk_tree  # noqa: F401
