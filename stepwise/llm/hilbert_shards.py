"""Operator 8, sharding along a Hilbert curve (built-in functions only).

Three metadata dimensions are quantised to ``2**BITS`` levels each: the place in doc_id order and
the size (both by quantiles over all rows) and a hash of (lang, source). A cell's index on the
Hilbert curve through that cube orders the rows; equal cells are ordered by a salt and doc_id.
Cutting the order into runs gives shards whose files hold narrow ranges of all dimensions.

Law ``rows``: shard counts differ by one at most. The exact place of every row comes from counts per
(cell, salt), summed up in two levels (the summary has a fixed number of cells), plus a row number
inside the (cell, salt) group, so no window holds a hot source or a large group of copies in one
task. Only short metadata rows are shuffled; texts are read once.

Nulls: a null text has size 1 (no bytes) and CRC 0, null metadata take level 0. Repeated rows are
rows of their own: the order among rows equal in every column doesn't matter. Of very long texts only the size and
the CRC are taken; empty tables give empty results. ``shard`` reads doc_id, text, lang and source only; ``write_shards``
keeps all columns, also ones named like its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BITS = 5
SHARDS = 16
#: groups a single cell is spread over; raise with the row count (rows / 2**(3 * BITS) / 1e6)
SALTS = 16
ACCURACY = 10_000


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index along the Hilbert curve of the cell with these coordinates (Skilling's transform)."""
    n = len(levels)
    names = [f"x{i}" for i in range(n)]

    def undo(acc: Column, q: Column) -> Column:
        x = [acc[k] for k in names]
        p = q - 1
        for i in range(n):
            hit = x[i].bitwiseAND(q) != 0
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            first, own = F.when(hit, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t)), F.when(hit, x[i]).otherwise(x[i].bitwiseXOR(t))
            if i:
                x[i] = own
            x[0] = first
        return F.struct(*[v.alias(k) for k, v in zip(names, x, strict=True)])

    masks = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    start = F.struct(*[v.cast("int").alias(k) for k, v in zip(names, levels, strict=True)])

    def finish(acc: Column) -> Column:
        x = [acc[names[0]]]
        for k in names[1:]:
            x.append(acc[k].bitwiseXOR(x[-1]))
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = F.when(x[-1].bitwiseAND(F.lit(1 << b)) != 0, t.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(t)
        x = [v.bitwiseXOR(t) for v in x]
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for v in x:
                out = out * 2 + F.shiftright(v, b).bitwiseAND(F.lit(1))
        return out

    return F.aggregate(masks, start, undo, finish)


def level(value: Column, cuts: list) -> Column:
    """How many cut points lie below the value (nulls: 0)."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value)), F.lit(0)) if cuts else F.lit(0)


def metadata(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64("lang", "source").alias("kind"))


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, salts: int = SALTS) -> DataFrame:
    """Metadata rows with their Hilbert ``cell``, global ``place``, ``shard`` and ``slot``."""
    meta = stored(metadata(docs), "shard-meta")
    n = 1 << bits
    at = [i / n for i in range(1, n)]
    cuts = meta.agg(F.percentile_approx("doc_id", at, ACCURACY).alias("id"), F.percentile_approx("size", at, ACCURACY).alias("size"),
                    F.count("*").alias("n")).first()
    dims = [level(F.col("doc_id"), cuts["id"] or []), level(F.col("size"), cuts["size"] or []),
            F.pmod(F.coalesce("kind", F.lit(0)), F.lit(n)).cast("int")]
    rows = meta.withColumn("cell", hilbert_index(dims, bits)).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).cast("int"))
    # counts per (cell, salt); first summed inside coarse runs of cells, then over the runs
    counts = rows.groupBy("cell", "salt").agg(F.count("*").alias("c")).withColumn("run", F.shiftright("cell", 2 * bits))
    inside = Window.partitionBy("run").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("c").alias("rc"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**bits rows
    starts = counts.withColumn("in_run", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(
        runs.withColumn("run_start", F.coalesce(F.sum("rc").over(before), F.lit(0))).drop("rc"), "run").select(
        "cell", "salt", (F.col("run_start") + F.col("in_run")).alias("first"))
    own = Window.partitionBy("cell", "salt").orderBy("doc_id", "text_crc32")
    placed = rows.withColumn("rn", F.row_number().over(own) - 1).join(starts, ["cell", "salt"]).withColumn(
        "place", F.col("first") + F.col("rn"))
    n_rows = max(1, cuts["n"])
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div {n_rows} as int)"))
    # the first place of shard s is ceil(s * n_rows / shards)
    return placed.withColumn("slot", F.col("place") - F.expr(f"(shard * {n_rows}L + {shards - 1}) div {shards}"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Whole documents as one folder per shard, rows in curve order (files prune on every dimension). The columns ``shard``
    and ``place`` are added; if ``docs`` has columns of these names, they stay and the added ones get underscores in front."""
    key = ["doc_id", "size", "text_crc32", "kind"]
    own = {}
    for name in ("shard", "place"):
        own[name] = name
        while own[name].lower() in (c.lower() for c in docs.columns):
            own[name] = "_" + own[name]
    # rows equal in all that the curve sees take the places of their kind one each
    same = Window.partitionBy(*key)
    placed = shard(docs, shards).select(*key, "shard", "place", F.row_number().over(same.orderBy("place")).alias("nth"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id",
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64("lang", "source").alias("kind"))
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy(F.lit(0)))).alias("r")
    placed = placed.alias("p")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*key, "nth"]]
    out = rows.join(placed, on).select("r.row.*", F.col("p.shard").alias(own["shard"]), F.col("p.place").alias(own["place"]))
    out.repartitionByRange(own["shard"], own["place"]).sortWithinPartitions(own["shard"], own["place"]).write.partitionBy(own["shard"]).parquet(path)
