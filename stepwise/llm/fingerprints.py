"""Operator 2, document fingerprints: one-permutation MinHash (built-in functions only).

A text's lower-cased words form five-word shingles; each shingle is hashed once. The top bits of the
hash name one of ``BINS`` bins and every bin keeps its smallest hash: after one sort of the hashes
these are the first of each run of equal bins. Empty bins are filled by optimal densification: bin i
asks bins picked by a 2-universal hash of (i, attempt) until one is not empty. The lowest ``WIDTH``
bits of each bin are packed as hex digits. Two unrelated values agree with probability 2**-WIDTH;
the likeness corrects for it: (agreement - c) / (1 - c), cut to 0..1.

Fewer words than a shingle: the whole sequence is one shingle. No words (null, empty or blank
texts): the fingerprint is the empty string, like (1.0) another empty one and unlike (0.0) all
others. Equal texts have equal fingerprints; the hash has no seed from the run. Repeated rows are fingerprinted
each, very long texts whole; empty tables give empty results. Only doc_id and text are read, so further columns,
whatever their names, neither disturb nor return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty

SHINGLE = 5
BINS = 256
WIDTH = 4
WHITE = r"[\x20\x09-\x0D]+"
#: draws an empty bin makes before it tries more
ROUNDS = (8, 64)
#: runs of doc_id order that the search for the next document is split into
RUNS = 256


def donor(dense: Column, i: Column, bins: int) -> Column:
    """The bin that empty bin ``i`` copies: the first filled one among independent draws by a hash of
    (bin, attempt); should all draws miss, the first filled one after a drawn place."""
    draw = lambda a: F.pmod(F.xxhash64(i, a), F.lit(bins)).cast("int")
    filled = lambda p: F.get(dense, p).isNotNull()
    first = lambda n: F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n)), draw), filled), F.lit(0))
    around = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda a: F.pmod(draw(F.lit(0)) + a, F.lit(bins))),
                            filled), F.lit(0))
    return F.coalesce(*[first(n) for n in ROUNDS], around)


def with_shingles(df: DataFrame, text: str, out: str, width: int = SHINGLE) -> DataFrame:
    """Adds ``out``: sorted 64-bit hashes of the word shingles of column ``text``."""
    h = f"{out}_h"
    words = F.array_remove(F.split(text, WHITE), "")
    df = df.withColumn(h, F.transform(words, lambda x: F.xxhash64(x)))
    many = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, width)]))
    return df.withColumn(out, F.when(F.size(h) >= width, F.sort_array(many)).when(
        F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))).drop(h)


def fingerprint(df: DataFrame, text: str, out: str, bins: int = BINS, width: int = WIDTH) -> DataFrame:
    """Adds ``out``: the packed fingerprint of column ``text``, an array of longs (empty: no words)."""
    s, m, d = (f"{out}_{x}" for x in "smd")
    shift, half = 64 - (bins - 1).bit_length(), bins // 2
    # signed order of the hashes starts with the upper half of the bins
    bin_of = lambda h: F.shiftright(h, shift).cast("int") + half
    df = with_shingles(df, text, s)
    df = df.withColumn(m, F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col(s), i - 1)))))
    # all bins in order, null where empty
    gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    before = lambda i: F.when(i == 0, -1).otherwise(bin_of(F.get(F.col(m), i - 1)))
    dense = F.concat(F.flatten(F.transform(m, lambda h, i: F.concat(gap(bin_of(h) - before(i) - 1), F.array(h)))),
                     gap(F.lit(bins - 1) - bin_of(F.element_at(m, -1))))
    df = df.withColumn(d, F.when(F.size(m) > 0, dense)).drop(s, m)
    low = F.lit((1 << width) - 1).cast("bigint")
    df = df.withColumn(m, F.transform(d, lambda v, i: F.coalesce(
        v, F.get(F.col(d), donor(F.col(d), i, bins))).bitwiseAND(low)))
    each = 64 // width
    packed = F.transform(F.sequence(F.lit(0), F.lit(bins // each - 1)), lambda k: F.aggregate(
        F.slice(F.col(m), k * each + 1, F.lit(each)), F.lit(0).cast("bigint"),
        lambda a, x: F.shiftleft(a, width).bitwiseOR(x)))
    return df.withColumn(out, F.when(F.col(m).isNotNull(), packed).otherwise(F.array().cast("array<bigint>"))).drop(d, m)


def as_text(packed: Column) -> Column:
    """A packed fingerprint as hex digits, one per bin."""
    return F.concat_ws("", F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column, bins: int = BINS, width: int = WIDTH) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, corrected for chance agreement."""
    ones = sum(1 << k for k in range(0, 64, width))
    lows = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones).cast("bigint")

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        any_bit = z
        for k in range(1, width):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(any_bit.bitwiseAND(lows))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda t, x: t + x)
    c = 2.0 ** -width
    est = (1 - off / F.lit(bins) - c) / (1 - c)
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(F.least(F.greatest(est, F.lit(0.0)), F.lit(1.0)))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on an id, in which nulls equal nulls, and a hash that is never null; the keys come
    from the left. All joins deal their rows by the same expressions, so exchanges can be shared."""
    left, right = left.alias("l"), right.alias("r")
    i, h = keys
    on = F.col(f"l.{i}").eqNullSafe(F.col(f"r.{i}")) & (F.col(f"l.{h}") == F.col(f"r.{h}"))
    return left.join(right, on).select("l.*", *[f"r.{c}" for c in right.columns if c not in keys])


def next_documents(keys: DataFrame, runs: int = RUNS) -> DataFrame:
    """(doc_id, h) with the next pair in order as (next_id, next_h); after the last comes the first.
    Order is cut into runs by quantiles; only one row per run meets in one task."""
    cuts = keys.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 10_000)).first()[0] or []
    run = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    rows = keys.withColumn("run", F.coalesce(run, F.lit(-1))).withColumn("k", F.struct("doc_id", "h"))
    firsts = rows.groupBy("run").agg(F.min("k").alias("k0"))
    order = Window.orderBy("run")  # at most ``runs`` rows
    firsts = firsts.select("run", F.coalesce(F.lead("k0").over(order), F.first("k0").over(order)).alias("after"))
    lead = F.lead("k").over(Window.partitionBy("run").orderBy("k"))
    out = rows.withColumn("nk", lead).join(firsts, "run").withColumn("nk", F.coalesce("nk", "after"))
    return out.select("doc_id", "h", F.col("nk.doc_id").alias("next_id"), F.col("nk.h").alias("next_h"))


def edited_pairs(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Every document with its edited text: the last half replaced by the start of the next document.
    Documents are told apart by (doc_id, hash of the text); rows equal in both count as one document
    when the next is sought, and each gets a row of its own in the result; the flag tells if there are any."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    keys = rows.groupBy("doc_id", "h").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n_chars"))
    keys = stored(keys, "fingerprint-keys")
    repeated = bool(keys.where("copies > 1").limit(1).count())
    follow = stored(next_documents(keys.select("doc_id", "h")), "fingerprint-next")
    want = same(follow, keys.drop("copies"), ["doc_id", "h"]).withColumn("half", F.expr("n_chars div 2").cast("int"))
    # both joins read the texts dealt by (doc_id, h), so the one exchange serves twice
    heads = want.alias("w").join(rows.alias("r"), F.col("w.next_id").eqNullSafe(F.col("r.doc_id")) & (F.col("w.next_h") == F.col("r.h"))).select(
        "w.doc_id", "w.h", "w.next_id", "w.next_h", F.expr("substring(r.text, 1, half)").alias("head"))
    if repeated:  # equal rows meet the same head several times
        heads = heads.dropDuplicates(["doc_id", "h"])
    both = same(rows, heads, ["doc_id", "h"]).withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), "head"))
    return both, repeated


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and edited texts, with their likeness to each other and to the next."""
    d, repeated = edited_pairs(docs)
    d = d.select("doc_id", "h", "next_id", "next_h", "n_chars", "text", "edited")
    d = d.withColumn("edited_sha256", F.sha2("edited", 256))
    d = fingerprint(d, "text", "f").drop("text")
    d = stored(fingerprint(d, "edited", "e").drop("edited"), "fingerprints")
    after = d.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("f").alias("nf"))
    if repeated:
        after = after.dropDuplicates(["next_id", "next_h"])
    return same(d, after, ["next_id", "next_h"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("nf")).alias("near_next"))
