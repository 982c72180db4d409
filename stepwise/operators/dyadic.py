"""Nodes of doubling size over ordered integer codes: short covers of long ranges, searches down a tree.

A node ``(level, number)`` stands for the codes whose ``code >> level`` is ``number`` (trees that branch
64 ways use every sixth level). A range of any length is a few nodes, and a code has one node per level, so
containment becomes an equi join and "the last earlier code whose value is smaller" a walk over tree levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DateType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType

#: codes outside this range are cut to its ends, so that differences never overflow
FARTHEST = 1 << 61
#: a node of the search tree has 2 ** FAN children
FAN = 6


def shift(code: Column, bits: Column | int) -> Column:
    """``code >> bits`` with the bits a column."""
    return F.call_function("shiftright", code, F.lit(bits).cast("int") if isinstance(bits, int) else bits.cast("int"))


def bounded(code: Column) -> Column:
    return F.greatest(F.least(code, F.lit(FARTHEST)), F.lit(-FARTHEST))


# ----------------------------------------------------------------------------- covers

def _both_ends(lo: Column, hi: Column, level: Column) -> Column:
    """The nodes of one level (none to two, the others null) in the cover of ``lo..hi``."""
    first, end = -shift(-lo, level), shift(hi + 1, level)  # the nodes of this level wholly in the range: first .. end - 1
    node = lambda n: F.struct(level.cast("int").alias("level"), n.alias("node"))
    # taken if the parent is not wholly in the range
    return F.array(F.when((first < end) & (first.bitwiseAND(F.lit(1)) == 1), node(first)),
                   F.when((first < end) & (end.bitwiseAND(F.lit(1)) == 1), node(end - 1)))


def _cover_levels(lo: Column, hi: Column) -> Column:
    return F.sequence(F.lit(0), F.length(F.bin(F.greatest(hi - lo, F.lit(0)))))


def cover(lo: Column, hi: Column) -> Column:
    """The shortest array of nodes ``struct<level, node>`` that make up the codes ``lo..hi`` (both included): at most two
    per level, empty if ``lo > hi``."""
    lo, hi = lo.cast("bigint"), hi.cast("bigint")
    return F.filter(F.flatten(F.transform(_cover_levels(lo, hi), lambda level: _both_ends(lo, hi, level))), lambda n: n.isNotNull())


def with_cover(df: DataFrame, lo: Column, hi: Column, name: str = "_node") -> DataFrame:
    """Each row once per node of ``cover(lo, hi)``; in plain projections, which compile where lambdas don't."""
    df = df.withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")}).filter("_lo <= _hi")
    df = df.withColumn("_level", F.explode(_cover_levels(F.col("_lo"), F.col("_hi"))))
    df = df.withColumn(name, F.explode(_both_ends(F.col("_lo"), F.col("_hi"), F.col("_level"))))
    return df.filter(F.col(name).isNotNull()).drop("_lo", "_hi", "_level")


def levels_of(nodes: DataFrame, level: str) -> Column:
    """The levels that occur in ``nodes`` as an array (a scalar subquery; at most 64 numbers)."""
    return nodes.select(F.array_sort(F.collect_set(level))).scalar()


def with_ancestors(df: DataFrame, code: str, levels: Column, name: str = "_node") -> DataFrame:
    """Each row once per level of ``levels``, with the node ``struct<level, node>`` that holds its code."""
    return df.withColumn("_level", F.explode(levels)).withColumn(
        name, F.struct(F.col("_level").alias("level"), shift(F.col(code), F.col("_level")).alias("node"))).drop("_level")


def pieces(lo: Column, hi: Column, at_least: int = 2) -> Column:
    """Nodes ``struct<level, node>`` of one level that hold ``lo..hi``, at most ``2 ** (at_least + 2) + 1`` of them
    whatever the length and more than ``2 ** (at_least - 1)`` if the range is that long. Levels are even, so codes need few
    ancestors. The nodes may reach beyond both ends."""
    size = F.length(F.bin(hi - lo))  # bits of the difference
    over = F.greatest(size - (at_least + 1), F.lit(0))
    level = (over - over % 2).cast("int")
    return F.transform(F.sequence(shift(lo, level), shift(hi, level)), lambda n: F.struct(level.alias("level"), n.alias("node")))


# ----------------------------------------------------------------------------- search

def exact_code(df: DataFrame, col: str) -> Column | None:
    """An integer that orders and identifies the column's values, or None for types without one."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return c.cast("bigint")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("bigint")
    if isinstance(kind, BooleanType):
        return c.cast("bigint")
    return None


class LastSmaller:
    """For probes (key, code, bound): the last leaf of the key before ``code`` whose value is below ``bound``.

    ``leaves`` has the columns ``key``, ``code`` (0 or more), ``value`` (not null) and ``item``. They form a tree that
    branches ``2 ** FAN`` ways, each node with its children's least values (a bounded array). A probe looks at its ancestors'
    earlier children, one row per level, takes the lowest that has a small enough one, and walks down from there, one row per
    level again. So a probe costs twice the tree's height, however many leaves its key has.
    """

    def __init__(self, leaves: DataFrame, largest: int) -> None:
        self.height = max(1, -(-max(largest, 1).bit_length() // FAN))
        levels = F.explode(F.sequence(F.lit(0), F.lit(self.height - 1))).alias("level")
        nodes = leaves.select("key", "code", "value", "item", levels)
        child = shift(F.col("code"), F.col("level") * FAN)
        # the item of a leaf; higher nodes only say that there is one
        nodes = nodes.groupBy("key", "level", child.alias("child")).agg(
            F.min("value").alias("value"), F.max(F.when(F.col("level") == 0, F.col("item"))).alias("item"))
        self.nodes = nodes.groupBy(F.col("key").alias("_tk"), F.col("level").alias("_tl"), F.shiftright("child", FAN).alias("_tp")).agg(
            F.sort_array(F.collect_list(F.struct("child", "value", "item"))).alias("_kids"))

    def _meet(self, probes: DataFrame, level: Column, parent: Column, how: str) -> DataFrame:
        return probes.join(self.nodes, (F.col("key") == F.col("_tk")) & (level == F.col("_tl")) & (parent == F.col("_tp")), how)

    def climb(self, probes: DataFrame) -> DataFrame:
        """One row per probe and level: the last earlier child with a small enough value (null if none)."""
        up = probes.select("key", "code", "bound", F.explode(F.sequence(F.lit(0), F.lit(self.height - 1))).alias("level"))
        own = shift(F.col("code"), F.col("level") * FAN)
        met = self._meet(up, F.col("level"), shift(own, FAN), "inner")
        fit = F.filter("_kids", lambda kid: (kid["child"] < own) & (kid["value"] < F.col("bound")))
        return met.select("key", "code", "bound", "level", F.get(fit, F.size(fit) - 1).alias("at"))

    def find(self, probes: DataFrame) -> DataFrame:
        """(key, code, bound, item) for the probes that have an answer."""
        start = F.struct("level", F.col("at.child").alias("child"), F.col("at.item").alias("item"))
        found = self.climb(probes).where("at is not null").groupBy("key", "code", "bound").agg(F.min(start).alias("at"))
        found = found.select("key", "code", "bound", F.col("at.level").alias("level"), F.col("at.child").alias("child"), F.col("at.item").alias("item"))
        for level in range(self.height - 1, 0, -1):
            here = F.when(F.col("level") == level, F.lit(level - 1))
            met = self._meet(found, here, F.col("child"), "left")
            fit = F.filter("_kids", lambda kid: kid["value"] < F.col("bound"))
            kid = F.get(fit, F.size(fit) - 1)
            down = F.col("_tk").isNotNull()
            found = met.select("key", "code", "bound", F.when(down, F.lit(level - 1)).otherwise(F.col("level")).alias("level"),
                               F.when(down, kid["child"]).otherwise(F.col("child")).alias("child"),
                               F.when(down, kid["item"]).otherwise(F.col("item")).alias("item"))
        return found.select("key", "code", "bound", "item")
