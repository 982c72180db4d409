"""Process-flow tree expansion (J26): root flow → active sub-flows (recursively) → active steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.functions.text import CARRIAGE_RETURN, pad_position, tsql_concat, tsql_default_width, tsql_plus
from stepwise.operators.grids import union_sources
from stepwise.operators.tree import materialize, walk_levels

OUTPUT_COLUMNS = ["RootFlowId", "RootFlowName", "FlowId", "FlowName", "IsAlternate", "PrettyFlowName",
                  "PrettyFlowChain", "PrettyPath", "FlowPath", "StepId", "StepName", "PrettyStep", "Level",
                  "TreePosition", "LogicalName", "DisplayOrder"]


def _definitions(flows: DataFrame, width: int | None) -> DataFrame:
    """What a definition is called in the tree: one row per flow id that others name as definition."""
    named = tsql_concat(F.col("Name"), F.lit(" ("), F.col("Description"), F.lit(")"))
    title = tsql_concat(F.col("Name"), F.lit(" ["), F.col("Revision"), F.lit("."), F.col("Version"), F.lit("] ("), F.col("Description"), F.lit(")"))
    return flows.select(F.col("FlowId").alias("_def"), F.col("Name").alias("_name"), F.col("Revision").alias("_revision"),
                        F.col("IsAlternate").alias("_alternate"), _cut(title, width).alias("PrettyFlowName"),
                        _cut(F.col("Description"), width).alias("_chain"), _cut(named, width).alias("_label"), F.col("Description").alias("_about"))


def _cut(text: F.Column, width: int | None) -> F.Column:
    """``CAST(… AS NVARCHAR(width))``: longer texts are cut."""
    return F.substring(text, 1, width) if width else text


def flow_tree(flows: DataFrame, subflows: DataFrame, flow_steps: DataFrame, steps: DataFrame, states: DataFrame,
              roots, *, active: str = "Active", width: int = 3, max_depth: int = 100,
              tsql_width: int | None = 30, chain_width: int | None = 1000) -> DataFrame:
    """The flow tree below each root flow id, one row per flow node and per attached step.

    * sub-flow edges are active edges from a source definition to the target flow's definition;
      their position is zero-padded to ``width`` with the ``+`` rule (too long → null);
    * each level extends the chains: names joined by ``-->``, pretty path by CR, flow path and
      position appended (T-SQL ``CONCAT``: nulls read as ''), level + 1;
    * active steps of each node hang one level below it; flow nodes appear with null step columns;
    * ``TreePosition`` pads the position with ``000`` per missing level up to the deepest level
      + 1 and is cut to 30 characters like an unsized ``NVARCHAR`` cast;
    * names, chains and paths are cut to ``chain_width`` characters at every level, their declared width.

    The recursion runs level by level (``walk_levels``: checkpointed frontier, depth guard), so
    the deepest level is known without a global window.
    """
    act = states.filter(F.col("Name") == F.lit(active)).select(F.col("UniversalStateId").alias("_state"))
    definitions = _definitions(flows, chain_width)
    place = pad_position(F.col("Position"), width, "plus")
    target = flows.select(F.col("FlowId").alias("_to"), F.col("DefinitionId").alias("_def"), F.col("Name").alias("FlowName"))
    subs = subflows.join(act, F.col("UniversalState") == F.col("_state")).join(target, F.col("TargetEntityId") == F.col("_to")).join(
        definitions, "_def").select(
        F.col("SourceEntityId").alias("SourceId"), F.col("_def").alias("TargetId"), "FlowName", "PrettyFlowName",
        (tsql_default_width(place, tsql_width) if tsql_width else place).alias("_place"), "_chain", "_label",
        F.col("_alternate").alias("IsAlternate"),
        tsql_concat(F.lit("/"), F.col("_name"), F.lit(":"), tsql_plus(F.col("_revision"), F.lit(":")), F.col("CorrelationID")).alias("_ids"),
        F.col("CorrelationID").cast("bigint").alias("CorrelationID"), "LogicalName")
    # the active edge table is joined once per level: resolve it once (flow graphs are small)
    subs = materialize(subs)

    root_ids = roots if isinstance(roots, DataFrame) else flows.sparkSession.createDataFrame([(r,) for r in roots], "FlowId bigint")
    top_flows = flows.join(root_ids.select(F.col(root_ids.columns[0]).alias("_root")), F.col("FlowId") == F.col("_root")).select(
        F.col("FlowId").alias("RootFlowId"), F.col("Name").alias("RootFlowName"), F.col("DefinitionId").alias("_def"), "IsAlternate")
    anchor = top_flows.join(definitions, "_def").select(
        "RootFlowId", "RootFlowName", F.col("_def").alias("SourceId"), F.col("_def").alias("TargetId"), F.col("RootFlowName").alias("FlowName"),
        "PrettyFlowName", F.col("_chain").alias("PrettyFlowChain"),
        _cut(tsql_concat(F.col("RootFlowName"), F.lit(" ("), F.col("_about"), F.lit(")")), chain_width).alias("PrettyPath"),
        _cut(tsql_concat(F.col("RootFlowName"), F.lit(":"), F.col("_revision"), F.lit(":"), F.lit("1")), chain_width).alias("FlowPath"),
        F.lit("001").alias("Position"), "IsAlternate", F.lit(1).alias("Level"), F.lit(1).cast("bigint").alias("CorrelationID"),
        F.lit("").alias("LogicalName"), F.lit(0).alias("DisplayOrder"))

    def step(level: DataFrame) -> DataFrame:
        above = level.select("RootFlowId", "RootFlowName", F.col("TargetId").alias("_from"), F.col("PrettyFlowChain").alias("_chains"),
                             F.col("PrettyPath").alias("_path"), F.col("FlowPath").alias("_flow"), F.col("Position").alias("_pos"), "Level")
        grown = lambda *parts: _cut(tsql_concat(*parts), chain_width)
        return above.join(subs, F.col("_from") == F.col("SourceId")).select(
            "RootFlowId", "RootFlowName", "SourceId", "TargetId", "FlowName", "PrettyFlowName",
            grown(F.col("_chains"), F.lit("-->"), F.col("_chain")).alias("PrettyFlowChain"),
            grown(F.col("_path"), F.lit(CARRIAGE_RETURN), F.col("_label")).alias("PrettyPath"),
            grown(F.col("_flow"), F.col("_ids")).alias("FlowPath"), grown(F.col("_pos"), F.col("_place")).alias("Position"),
            "IsAlternate", (F.col("Level") + 1).alias("Level"), "CorrelationID", "LogicalName", F.lit(0).alias("DisplayOrder"))

    tree, max_level = walk_levels(anchor, step, level_col="Level", max_depth=max_depth, base_level=1)
    top = (max_level or 0) + 1  # deepest node level + 1 (the flow-node branch's MAX(Level + 1))

    fs = flow_steps.alias("fs").join(act, F.col("fs.UniversalState") == F.col("_state"))
    st = steps.alias("s")
    t = tree.alias("t")
    sb = t.join(fs, F.col("fs.SourceEntityId") == F.col("t.TargetId")).join(st, F.col("s.StepId") == F.col("fs.TargetEntityId"))
    label = F.coalesce(F.col("fs.LogicalName"), F.col("s.Description"))
    step_rows = sb.select(
        F.col("t.RootFlowId"), F.col("t.RootFlowName"), F.col("t.SourceId"), F.col("t.FlowName"), F.col("t.IsAlternate"),
        F.col("t.PrettyFlowName"), F.col("t.PrettyFlowChain"),
        tsql_concat(F.col("t.PrettyPath"), F.lit(CARRIAGE_RETURN), F.col("s.Name"), F.lit(" ("), label, F.lit(")")).alias("PrettyPath"),
        tsql_concat(F.col("t.FlowPath"), F.lit("/"), F.col("s.Name"), F.lit(":"), F.col("fs.CorrelationID")).alias("FlowPath"),
        F.col("s.StepId").cast("bigint").alias("StepId"), F.col("s.Name").alias("StepName"),
        tsql_concat(F.col("s.Name"), F.lit(" ("), label, F.lit(")")).alias("PrettyStep"),
        (F.col("t.Level") + 1).alias("Level"),
        tsql_concat(F.col("t.Position"), pad_position(F.col("fs.Position"), width, "concat")).alias("Position"),
        F.col("fs.LogicalName").alias("LogicalName"), F.col("s.DisplayOrder").cast("int").alias("DisplayOrder"))
    node_rows = tree.select(
        "RootFlowId", "RootFlowName", "SourceId", "FlowName", "IsAlternate", "PrettyFlowName", "PrettyFlowChain",
        "PrettyPath", "FlowPath", F.lit(None).cast("bigint").alias("StepId"), F.lit(None).cast("string").alias("StepName"),
        F.lit(None).cast("string").alias("PrettyStep"), "Level", "Position", "LogicalName",
        F.lit(0).alias("DisplayOrder"))
    b = union_sources(step_rows, node_rows)
    tree_pos = tsql_plus(F.col("Position"), F.repeat(F.lit("0"), F.lit(3) * (F.lit(top) - F.col("Level"))))
    if tsql_width:
        tree_pos = tsql_default_width(tree_pos, tsql_width)
    return b.select("RootFlowId", "RootFlowName", F.col("SourceId").alias("FlowId"), "FlowName", "IsAlternate",
                    "PrettyFlowName", "PrettyFlowChain", "PrettyPath", "FlowPath", "StepId", "StepName", "PrettyStep",
                    "Level", tree_pos.alias("TreePosition"), "LogicalName", "DisplayOrder")
