"""Operator 4, URL filter: listed rules first, else gradient-boosted trees on lexical features.

A rule is a host and a path: it fits its host and all subdomains when the url's path starts with the
rule's; the longest fitting rule decides. Other urls get the verdict of a boosted-tree model (Spark's
``GBTClassifier``) over lexical features: lengths, depth, digit ratio, character entropy, hyphens,
labels, parameters, and how often urls of the suffix are blocked.

Labelled urls are those no rule covers: blocked where the host carries a listed spam term, allowed
elsewhere. The model is trained on at most ``TRAIN_ROWS`` of them, picked by a hash of the url; the
terms themselves are no feature, so the model also judges hosts the list doesn't name. Training that
meets one class only yields that class.

Null urls and urls without ``://`` have empty host and path and are judged like any other. Repeated
rows are judged each; very long urls are measured whole; empty tables give empty results. Only ``page_id`` and ``url``
are read: further columns, whatever their names, neither disturb the model's own nor return.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: host terms that mark labelled spam urls (fixed list)
SPAM_TERMS = ("casino", "bets", "poker", "pills", "viagra", "adult", "porn", "xxx", "spam", "track", "clickbait", "warez")
TRAIN_ROWS = 20_000
TREES, DEPTH = 15, 3
SUFFIXES = 1_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(df: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    return df.withColumn("host", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(url, PARTS, 2))


def fitting_rule(rules: tuple[tuple[str, str, str], ...], field: int | None) -> Column:
    """The longest fitting rule's verdict (field 0) or text (None); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(rule[0] if field == 0 else host + path)).otherwise(out)
    return out


def lexical_features(df: DataFrame, suffix_rates: dict[str, float], rate: float) -> DataFrame:
    """Adds ``features``, an array of doubles."""
    url = F.coalesce("url", F.lit(""))
    chars = F.array_remove(F.split(F.col("host"), ""), "")
    n = F.greatest(F.size(chars), F.lit(1))
    entropy = -F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n),
                           F.lit(0.0), lambda a, p: a + p * F.log2(p))
    digits = lambda c: F.length(c) - F.length(F.regexp_replace(c, "[0-9]", ""))
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)
    suffix = F.element_at(F.split("host", r"\."), -1)
    table = F.create_map(*[x for k, v in sorted(suffix_rates.items()) for x in (F.lit(k), F.lit(v))]) if suffix_rates else None
    known = F.coalesce(F.try_element_at(table, suffix), F.lit(rate)) if table is not None else F.lit(rate)
    parts = [F.length(url), F.length("host"), F.length("path"), count(F.col("path"), "/"), count(F.col("host"), "."),
             count(F.col("host"), "-"), digits(F.col("host")) / n, digits(url) / F.greatest(F.length(url), F.lit(1)),
             entropy, count(url, "="), count(url, "&"), count(url, "%"), url.startswith("https").cast("int"), known]
    return df.withColumn("features", F.array(*[p.cast("double") for p in parts]))


def labelled(urls: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` distinct labelled urls: (url, host, path, label)."""
    spam = reduce(lambda a, b: a | b, [F.col("host").contains(t) for t in SPAM_TERMS])
    free = with_parts(urls.select("url").distinct()).where(fitting_rule(RULES, 0).isNull())
    return free.withColumn("label", spam.cast("double")).orderBy(F.xxhash64("url"), "url").limit(rows)


def judge(pages: DataFrame) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    train = stored(labelled(pages), "url-train")
    suffix = F.element_at(F.split("host", r"\."), -1)
    rates = {r["s"]: r["rate"] for r in train.groupBy(suffix.alias("s")).agg(
        ((F.sum("label") + 1) / (F.count("*") + 2)).alias("rate"), F.count("*").alias("n")).orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()}
    sums = train.agg(F.sum("label").alias("spam"), F.count("*").alias("n")).first()
    rate = (sums["spam"] or 0.0) / max(1, sums["n"])
    rows = with_parts(pages.select("page_id", "url")).withColumn("rule", fitting_rule(RULES, None)).withColumn("ruled", fitting_rule(RULES, 0))
    if 0 < rate < 1:
        vector = lambda df: lexical_features(df, rates, rate).withColumn("features", array_to_vector("features"))
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(vector(train))
        rows = model.transform(vector(rows))
        own = F.when(F.col("prediction") >= 0.5, "block").otherwise("allow")
    else:
        own = F.lit("block" if rate == 1 else "allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"))
