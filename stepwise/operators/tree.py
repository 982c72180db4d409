"""Recursive expansion (``WITH t AS (anchor UNION ALL member JOIN t)``) as a level-by-level loop.

Each level is one distributed join of the current frontier with the edge table. The frontier is
materialised with a reliable ``checkpoint()`` into the session's ``spark.checkpoint.dir`` (a shared
folder), which cuts the lineage so a deep tree neither re-plans a growing union nor loses work when
an executor disappears. The loop stops when a level is empty; exceeding ``max_depth`` raises, as the
warehouse's recursion limit does (this also guards against cycles).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.session import checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a (small, reused) table into the session's checkpoint folder."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def walk_levels(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], *, level_col: str = "Level",
                max_depth: int = 100, checkpoint_every: int = 1, base_level: int | None = None) -> tuple[DataFrame, int]:
    """Run ``frontier = step(frontier)`` from ``anchor`` until empty; return (union of levels, max level).

    ``step`` maps the rows of one level to the rows of the next (typically a join with edges).
    The returned max level is known from the loop itself, so no global ``MAX() OVER ()`` is needed.
    Pass ``base_level`` when the anchor's level is known, to save one job.
    """
    spark = anchor.sparkSession
    checkpoint_dir(spark)
    frontier = anchor.checkpoint(eager=True)
    if frontier.isEmpty():
        return frontier, None
    base = base_level if base_level is not None else frontier.agg(F.min(level_col)).first()[0]
    levels = [frontier]
    depth = 0  # recursions so far; the anchor is none
    while True:
        nxt = step(frontier)
        if (depth + 1) % checkpoint_every == 0:
            nxt = nxt.checkpoint(eager=True)
        if nxt.isEmpty():
            break
        depth += 1
        if depth > max_depth:
            raise RuntimeError(f"recursion exceeded {max_depth} steps (cycle in the graph?)")
        levels.append(nxt)
        frontier = nxt
    out = levels[0]
    for lv_df in levels[1:]:
        out = out.unionByName(lv_df)
    return out, base + depth


def walk_tree(edges: DataFrame, roots: DataFrame, *, src: str = "src", dst: str = "dst", max_depth: int = 100) -> DataFrame:
    """Every node reachable from each root with its level (root = 1), one join per level.

    ``roots`` has one column of root node ids. Returns ``(root, node, Level)``.
    """
    r = roots.select(F.col(roots.columns[0]).alias("root"))
    anchor = r.select("root", F.col("root").alias("node"), F.lit(1).alias("Level"))
    e = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst"))

    def step(fr: DataFrame) -> DataFrame:
        return fr.join(e, fr["node"] == e["_src"]).select("root", F.col("_dst").alias("node"), (F.col("Level") + 1).alias("Level"))

    out, _ = walk_levels(anchor, step, max_depth=max_depth, base_level=1)
    return out
