"""Operator 5, quality rules by distribution divergence (built-in functions only).

A text is compared with a reference of its language twice: by its histogram over character classes
and by its histogram over the language's commonest words. The measure is the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1). References are the bin-wise medians over
all documents of the language that pass the base rules, so up to half of them may be junk without
moving them; they are four short rows. A text shorter than ``min_words`` words is too short for a
stable histogram and is left to the base rules.

One pass over the texts leaves one short row of counts per document (written to the shared folder);
references and verdicts read only those rows.

Nulls and empty texts: no words, so the base rule rejects them. Repeated rows are judged each.
Unknown or null languages are compared with every reference and keep the smallest distance. Very long texts are
counted whole; empty tables give empty results. Only doc_id, text and lang are read (``accepted`` joins its verdicts back
by key), so further columns, whatever their names, don't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"
#: character classes, taken off the text one after the other; what is left over is "other"
CLASSES = {"lower": "[a-z]+", "white": WHITE, "upper": "[A-Z]+", "letter": r"\p{L}+", "digit": "[0-9]+",
           "stop": r"[.,;:?!'\x22()\-]+"}
#: commonest function words of each language (fixed values)
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "on", "with", "as", "by", "this", "be", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una"],
}
MIN_WORDS = 50
#: largest distances that still count as the language
MAX_CHARS, MAX_COMMON = 0.18, 0.60


def base_counts(docs: DataFrame) -> DataFrame:
    """One row of counts per document: the base counters and both histograms."""
    d = docs.select("doc_id", "lang", text_or_empty().alias("t"))
    d = d.withColumn("w", F.array_remove(F.split("t", WHITE), ""))
    before = "t"
    for name, pattern in CLASSES.items():  # each pass works on the rest of the one before
        d = d.withColumn(f"rest_{name}", F.regexp_replace(before, pattern, ""))
        d = d.withColumn(f"c_{name}", F.length(before) - F.length(f"rest_{name}"))
        before = f"rest_{name}"
    n = F.size("w")
    # 3-word windows by a 64-bit hash; a window counts as repeated if a neighbour in hash order is equal
    d = d.withColumn("g", F.when(n >= 3, F.transform(
        F.slice("w", 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"),
                                 F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    covered = F.array_distinct(F.flatten(F.transform(
        F.filter(F.transform("s", lambda x, j: F.when(
            (x["h"] == F.get(F.col("s"), j + 1)["h"]) | (x["h"] == F.get(F.col("s"), j - 1)["h"]), x["i"])),
            lambda i: i.isNotNull()),
        lambda i: F.array(i, i + 1, i + 2))))
    lines = "filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    d = d.withColumn("l", F.expr(lines))
    words = sorted({w for ws in COMMON.values() for w in ws})
    d = d.withColumn("v", F.filter("w", lambda x: x.isin(words + [w.capitalize() for w in words])))
    count = lambda word: F.size(F.filter("v", lambda x: x.isin(word, word.capitalize()))).cast("long")
    hist = lambda lang: F.array(*map(count, COMMON[lang]))
    return d.select(
        "doc_id", F.xxhash64("t").alias("h"), "lang", n.cast("long").alias("n_words"), F.length("t").cast("long").alias("n_chars"),
        (F.length("t") - F.col("c_white")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("rest_upper", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
        *[F.col(f"c_{c}").cast("long").alias(f"c_{c}") for c in CLASSES],
        *[F.when(F.col("lang").isin([x for x in COMMON if x != k]), F.lit(None)).otherwise(hist(k)).alias(f"k_{k}")
          for k in COMMON],
    )


def histograms(counts: DataFrame) -> DataFrame:
    """The counts with ``chars`` and one ``words_<lang>`` histogram of shares each."""
    c = [F.col(f"c_{x}") for x in CLASSES]
    rest = F.col("n_chars") - reduce(lambda a, b: a + b, c)
    share = lambda cols, total: F.when(total > 0, F.array(*[x / total for x in cols]))
    out = counts.withColumn("chars", share([*c, rest], F.col("n_chars")))
    for k, words in COMMON.items():
        have = [F.get(f"k_{k}", F.lit(i)) for i in range(len(words))]
        other = F.col("n_words") - reduce(lambda a, b: a + b, have)
        out = out.withColumn(f"words_{k}", share([*have, other], F.col("n_words")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(hists: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Language -> (character reference, word reference); one row per known language."""
    n = len(CLASSES) + 1
    aggs = []
    for k, words in COMMON.items():
        own = (F.col("lang") == k) & ~F.col("base_failed")
        aggs += [F.percentile_approx(F.when(own, F.get("chars", F.lit(i))), 0.5, 1000).alias(f"{k}_c{i}") for i in range(n)]
        aggs += [F.percentile_approx(F.when(own, F.get(f"words_{k}", F.lit(i))), 0.5, 1000).alias(f"{k}_w{i}")
                 for i in range(len(words) + 1)]
    row = hists.agg(*aggs).first()
    out = {}
    for k, words in COMMON.items():
        both = [[row[f"{k}_{kind}{i}"] for i in range(m)] for kind, m in (("c", n), ("w", len(words) + 1))]
        if both[0][0] is not None:
            out[k] = tuple([x / (sum(xs) or 1.0) for x in xs] for xs in both)
    return out


def js_distance(hist: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    total = F.aggregate(F.zip_with(hist, ref, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """Counters, distances and verdicts, one row per document."""
    counts = stored(base_counts(docs), "quality-counts")
    hists = histograms(counts)
    refs = references(hists)
    def distance(which: int) -> Column:
        if not refs:
            return F.lit(0.0)
        per = {k: js_distance(F.col("chars" if which == 0 else f"words_{k}"), F.array(*map(F.lit, r[which])))
               for k, r in refs.items()}
        own = F.lit(None).cast("double")
        for k, d in per.items():
            own = F.when(F.col("lang") == k, d).otherwise(own)
        nearest = F.array_min(F.array(*per.values()))
        return F.when(F.col("lang").isin(list(refs)), own).otherwise(nearest)

    out = hists.withColumn("char_distance", distance(0)).withColumn("word_distance", distance(1))
    off = (F.col("n_words") >= MIN_WORDS) & (
        (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHARS) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_COMMON))
    return out.withColumn("kept", ~F.col("base_failed") & ~off).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "char_distance", "word_distance", "h")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep; rows are found again by doc_id and text."""
    kept = judge(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["_h"])
    return docs.join(kept, same, "left_semi")
