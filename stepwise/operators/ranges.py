"""Counts and sums of the points in every range, without a row per point and range.

A range has a **level** by its own length: nodes of ``2 ** level`` codes, of which it meets two to five (any number at the
top level). Points up to its end in its last node are a running total from the node's start, points from its beginning in its
first node one from the node's end, and whole nodes between are a few dyadic totals. So a range is two lookups and a node or
two, and the points are dealt out once, whatever the lengths. Totals are added, never differenced, because differences
of running sums of doubles would not be the exact sums of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from stepwise.operators.dyadic import shift, with_cover

#: a batch of rows is handed on when it has so many list entries
ENTRIES = 500_000


def _level(lo: Column, hi: Column, top: int) -> Column:
    """The largest level at an even distance below ``top`` (or 0) whose nodes are not longer than ``hi - lo``."""
    size = F.length(F.bin(F.coalesce(F.try_subtract(hi, lo), F.lit(1 << 62)))) - 1
    below = F.lit(top) - F.least(size, F.lit(top))
    return F.greatest(F.lit(top) - below - below % 2, F.lit(0)).cast("int")


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    """The column as numbers of its distinct values, and those values (the last is None)."""
    found = column.dictionary_encode()
    return found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False), [*found.dictionary.to_pylist(), None]


def _rows(batch: pa.RecordBatch, carried: Sequence[str], at: list, ends: list, items: list, counts: list, totals: list) -> pa.RecordBatch:
    """The rows ``at`` of the batch with their totals and with the parts of ``items`` and ``counts`` up to their ``ends``."""
    ends = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(items, pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
    own = [batch.column(c).take(pa.array(at)) for c in carried]
    return pa.RecordBatch.from_arrays([pa.array(totals, pa.float64()), *own, *lists], names=["total", *carried, "items", "counts"])


def _running(carried: Sequence[str]):
    """Over rows sorted by (key, level, side, place), points before marks: each mark with the counts per item (in the items'
    order) and the sum of the points before it in its node. Holds one count per item of a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, counts, names, total = None, {}, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            plain = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("_l", "_node", "_side", "_mark")}
            (key, keys), (item, items) = _coded(batch.column("key")), _coded(batch.column("item"))
            of = [key, *(plain[c] for c in ("_l", "_node", "_side"))]
            starts = np.ones(batch.num_rows, bool)
            starts[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in of])
            own = lambda i: (keys[key[i]], *(int(x[i]) for x in of[1:]))  # noqa: B023, E731
            starts[0] = own(0) != group
            group = own(-1)
            values = batch.column("value").fill_null(0.0).to_numpy(zero_copy_only=False).tolist()
            known = batch.column("value").is_valid().to_numpy(zero_copy_only=False).tolist()
            item = [items[i] for i in item.tolist()]
            at, ends, found, numbers, totals = [], [0], [], [], []
            for i, (start, mark) in enumerate(zip(starts.tolist(), plain["_mark"].tolist(), strict=True)):
                if start:
                    counts, names, total = {}, [], None
                if not mark:
                    name = item[i]
                    counts[name] = counts.get(name, 0) + 1
                    if known[i]:
                        total = values[i] if total is None else total + values[i]
                elif counts:
                    if len(names) < len(counts):
                        names = sorted(counts, key=lambda n: (n is not None, n))
                    at.append(i)
                    found += names
                    numbers += [counts[n] for n in names]
                    ends.append(len(found))
                    totals.append(total)
                    if len(found) >= ENTRIES:
                        yield _rows(batch, carried, at, ends, found, numbers, totals)
                        at, ends, found, numbers, totals = [], [0], [], [], []
            if at:
                yield _rows(batch, carried, at, ends, found, numbers, totals)
    return run


def range_totals(points: DataFrame, ranges: DataFrame, top: int) -> DataFrame:
    """For ranges ``(key, lo, hi, …)`` and points ``(key, code, item, value)``: rows ``(total, …, items, counts)``, one to a few
    per range that holds any point (both ends included), to be added up: how often each item occurs, as two arrays (a
    null item is one too), and the sum of the values (null if all are). Equal ranges count each for itself.

    No node is longer than ``2 ** top`` codes. A key's points of one such node, and the marks of the ranges that begin or end
    there, are sorted in one task; a longer range adds up whole nodes in between.
    """
    carried = [c for c in ranges.columns if c not in ("key", "lo", "hi")]
    # columns whose bytes differ from row to row stand side by side, which makes the shuffle files smaller
    points = points.filter("key is not null").select(F.col("value").cast("double").alias("value"), "code", "key", F.col("item").cast("string").alias("item"))
    # no filter or choice of columns passes the explode, so that all reads of the ranges share the exchanges below it
    r = ranges.select(F.explode(F.array(F.struct(*ranges.columns))).alias("_range")).select("_range.*")
    r = r.filter("key is not null and lo <= hi").withColumn("_l", _level(F.col("lo"), F.col("hi"), top))
    first, last = shift(F.col("lo"), F.col("_l")), shift(F.col("hi"), F.col("_l"))
    levels = r.select(F.collect_set("_l")).scalar()

    # a mark at each end; side 1 runs from a node's end to its start
    mark = lambda side, code: F.struct(F.lit(side).alias("_side"), F.col(code).alias("code"))
    marks = r.withColumn("_end", F.explode(F.array(mark(0, "hi"), F.when(first < last, mark(1, "lo"))))).filter("_end is not null")
    marks = marks.select("_end.code", "key", "_l", "_end._side", *carried)
    both = points.unionByName(marks, allowMissingColumns=True)
    # dealt out once; levels and sides are made where the rows lie, because a node lies in one of the top level
    dealt = both.repartition("key", shift(F.col("code"), top)).withColumn("_mark", F.col("_l").isNotNull())
    dealt = dealt.withColumn("_l", F.explode(F.when(F.col("_mark"), F.array("_l")).otherwise(levels)))
    dealt = dealt.withColumn("_side", F.explode(F.when(F.col("_mark"), F.array("_side")).otherwise(F.array(F.lit(0), F.lit(1)))))
    place = F.when(F.col("_side") == 1, -F.col("code")).otherwise(F.col("code")).alias("_place")
    rows = dealt.select("key", "_l", "_side", place, "_mark", "item", "value", *carried)
    # in the order of places a node's rows are together
    rows = rows.sortWithinPartitions("key", "_l", "_side", "_place", "_mark")
    node = shift(F.when(F.col("_side") == 1, -F.col("_place")).otherwise(F.col("_place")), F.col("_l")).alias("_node")
    kinds = [ranges.schema[c] for c in carried]
    kinds = StructType([StructField("total", DoubleType()), *(StructField(f.name, f.dataType) for f in kinds),
                        StructField("items", ArrayType(StringType())), StructField("counts", ArrayType(LongType()))])
    at_ends = rows.select("*", node).mapInArrow(_running(carried), kinds)

    # the whole nodes between, by the range's level and the levels above that its cover takes
    inner = with_cover(r, first + 1, last - 1, "_n").select("key", "_l", F.col("_n.level").alias("_up"), F.col("_n.node").alias("_node"), *carried)
    used = inner.select(F.collect_set(F.struct("_l", "_up"))).scalar()
    totals = points.withColumn("_l", F.explode(F.array_distinct(used.getField("_l"))))
    totals = totals.groupBy("key", "_l", shift(F.col("code"), F.col("_l")).alias("_node"), "item").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("value").alias("value"))
    totals = totals.withColumn("_use", F.explode(used)).filter("_use._l = _l").withColumn("_up", F.col("_use._up"))
    totals = totals.groupBy("key", "_l", "_up", shift(F.col("_node"), F.col("_up")).alias("_node"), "item").agg(
        F.sum("_c").alias("_c"), F.sum("value").alias("value"))
    on = ["key", "_l", "_up", "_node"]
    packed = totals.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("item", "_c"))).alias("_of"), F.sum("value").alias("total"))
    whole = inner.join(packed, on).select("total", *carried, F.col("_of.item").alias("items"), F.col("_of._c").alias("counts"))
    return at_ends.unionByName(whole)
