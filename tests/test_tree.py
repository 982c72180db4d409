import pytest
from pyspark.sql import functions as F

from stepwise.operators.tree import walk_levels
from stepwise.plans.flowtree import flow_tree


def _chain(spark, depth, cycle=False):
    flows = [(i, i, f"F{i}", "A", "1", f"d{i}", False) for i in range(1, depth + 2)]
    subs = [(i, i + 1, str(i), i, None, 1) for i in range(1, depth + 1)]
    if cycle:
        subs.append((depth + 1, 1, "1", 1, None, 1))
    f = spark.createDataFrame(flows, "FlowId long, DefinitionId long, Name string, Revision string, Version string, "
                                     "Description string, IsAlternate boolean")
    s = spark.createDataFrame(subs, "SourceEntityId long, TargetEntityId long, Position string, CorrelationID long, "
                                    "LogicalName string, UniversalState long")
    return f, s


def _empty_steps(spark):
    fs = spark.createDataFrame([], "SourceEntityId long, TargetEntityId long, Position string, CorrelationID long, "
                                   "LogicalName string, UniversalState long")
    st = spark.createDataFrame([], "StepId long, Name string, Description string, DisplayOrder int")
    states = spark.createDataFrame([(1, "Active"), (2, "Inactive")], "UniversalStateId long, Name string")
    return fs, st, states


def test_deep_tree_levels_positions_and_padding(spark):
    f, s = _chain(spark, 12)
    fs, st, states = _empty_steps(spark)
    out = flow_tree(f, s, fs, st, states, [1]).orderBy("Level").collect()
    assert [r.Level for r in out] == list(range(1, 14))
    top = out[-1]
    # positions: '001' root, then 001..009, 010, 011, 012 (each padded to 3); cut at 30 characters
    assert top.TreePosition == ("001" + "".join(f"{i:03d}" for i in range(1, 13)))[:30]
    assert out[0].TreePosition == ("001" + "000" * 13)[:30]
    assert top.PrettyFlowChain.count("-->") == 12 and "\r" in top.PrettyPath


def test_inactive_subflow_and_four_digit_position(spark):
    flows = spark.createDataFrame([(1, 1, "R", "A", "1", "root", False), (2, 2, "X", None, "1", "x", True),
                                   (3, 3, "Y", "B", "1", "y", False)],
                                  "FlowId long, DefinitionId long, Name string, Revision string, Version string, "
                                  "Description string, IsAlternate boolean")
    subs = spark.createDataFrame([(1, 2, "1234", 7, "lx", 1), (1, 3, "5", 8, None, 2)],
                                 "SourceEntityId long, TargetEntityId long, Position string, CorrelationID long, "
                                 "LogicalName string, UniversalState long")
    fs = spark.createDataFrame([(2, 50, "7", 1, None, 1)], "SourceEntityId long, TargetEntityId long, Position string, "
                                                           "CorrelationID long, LogicalName string, UniversalState long")
    st = spark.createDataFrame([(50, "S", "desc", 4)], "StepId long, Name string, Description string, DisplayOrder int")
    states = spark.createDataFrame([(1, "Active"), (2, "Inactive")], "UniversalStateId long, Name string")
    out = {(r.FlowId, r.StepId): r for r in flow_tree(flows, subs, fs, st, states, [1]).collect()}
    assert (3, None) not in out  # inactive edge
    node = out[(1, None)]  # the child node X: FlowId is the edge source
    assert node.Level == 2 and node.TreePosition == "001000"  # 4-digit position -> null piece, CONCAT keeps '001'
    assert node.FlowPath == "R:A:1/X:7"  # Revision null: (Revision + ':') drops, CONCAT keeps the rest
    step = out[(1, 50)]
    assert step.Level == 3 and step.TreePosition == "001007" and step.PrettyStep == "S (desc)"


def test_cycle_is_stopped(spark):
    f, s = _chain(spark, 3, cycle=True)
    fs, st, states = _empty_steps(spark)
    with pytest.raises(RuntimeError):
        flow_tree(f, s, fs, st, states, [1], max_depth=20)


def test_walk_levels_returns_max_level(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    anchor = spark.createDataFrame([(1, 1)], "node long, Level int")
    out, top = walk_levels(anchor, lambda fr: fr.join(edges, fr.node == edges.src).select(F.col("dst").alias("node"), (F.col("Level") + 1).alias("Level")))
    assert top == 4 and out.count() == 4


def test_chains_are_cut_to_their_declared_width(spark):
    from stepwise.plans.flowtree import flow_tree

    flows = spark.createDataFrame([(i, i, "n" * 100 + str(i), "A", "1", "d" * 120, False) for i in range(1, 13)],
                                  "FlowId long, DefinitionId long, Name string, Revision string, Version string, Description string, IsAlternate boolean")
    subs = spark.createDataFrame([(i, i + 1, "1", i, None, 1) for i in range(1, 12)],
                                 "SourceEntityId long, TargetEntityId long, Position string, CorrelationID long, LogicalName string, UniversalState long")
    none = spark.createDataFrame([], subs.schema)
    steps = spark.createDataFrame([], "StepId long, Name string, Description string, DisplayOrder long")
    states = spark.createDataFrame([(1, "Active")], "UniversalStateId long, Name string")
    rows = flow_tree(flows, subs, none, steps, states, [1]).collect()
    assert len(rows) == 12 and max(len(r.PrettyPath) for r in rows) == max(len(r.PrettyFlowChain) for r in rows) == 1000
    longer = flow_tree(flows, subs, none, steps, states, [1], chain_width=None).collect()
    assert max(len(r.PrettyPath) for r in longer) > 2000
