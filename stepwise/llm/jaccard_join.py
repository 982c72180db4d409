"""Operator 10, n-gram Jaccard join: size-aware, heavy-light.

A document's set holds its distinct word shingles (five words, A-Z lower-cased; with fewer words the
whole sequence). Two documents link when 7 * common >= 3 * (size + size), that is, when their Jaccard
similarity is at least 0.75. Documents with one and the same set are one class from the start.

* *Small sets* enumerate their subsets of every fixed size that a linked partner may share. Two sets
  with a common subset of size c link when 7 * c >= 3 * (size + size); among the sets of a subset a
  link to the smallest one implies all others, so one link each is whole.
* *Large sets* scan inverted lists of their prefixes: under one order of all shingles, linked sets
  share one of their first size - ceil(0.75 * size) + 1. The order puts frequent shingles (counted in a
  fixed share of the documents) last; any order is right, this one keeps lists short at every size.
* *The boundary* minimises the counted cost of both: subsets of all sets up to it against list entries
  above. Sets within 3/4 below the boundary do both, so pairs across it are found in the lists.

Lists with the same members are one. Lists of up to ``SHORT`` classes give their pairs. Longer lists with
the same least member are one bundle, matched in blocks inside a task on bit sketches whose distance
never exceeds the symmetric difference (an exact bound): first every set gets one neighbour (a star
cover, not all pairs), links are verified on whole texts and merged into components. Then only bundles
whose members lie in several components are read: round by round, sets outside a block's largest
component meet more and more of their nearest sets of other components, until no pair that the bound
allows is both apart and untested. So no link between different components is missed, and a cluster of
thousands of near copies costs a few links and a few sketches each.

Texts without words (or null) have the empty set and are linked with nothing. Repeated rows with words
are one class. A null doc_id takes part; the component's id is its smallest non-null doc_id. Very long texts
have long sets, verified whole; empty tables give empty results. ``near_duplicates`` reads doc_id and text only;
``one_of_each`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty
from .components import components
from .hashing import mix, shingles

WIDTH = 5
#: cost of a list entry against a subset key: it may lead to a verification
ENTRY_COST = 9.0
LARGEST_SMALL = 12
SHORT = 32
BLOCK = 8_192
#: neighbours of each set that the first round after the star cover verifies
FIRST_NEAREST = 8
#: one document in ``SAMPLE_ONE_IN`` shows which shingles are frequent (of small tables ``SAMPLE_DOCS`` of them)
SAMPLE_DOCS, SAMPLE_ONE_IN = 4_000, 16
#: classes a task remembers in order to give out their keys once
REMEMBERED = 200_000
FREQUENT, FREQUENT_AT = 50_000, 4
#: residues that the texts' reader is told of; a longer list of wanted texts only filters less
RESIDUES = 1 << 18
LEAST_BITS, MOST_BITS = 64, 1 << 15


def class_key(s: np.ndarray) -> int:
    """64-bit name of a set."""
    x = mix(s)
    parts = (np.bitwise_xor.reduce(x, keepdims=True), x.sum(dtype=np.uint64, keepdims=True), np.array([len(x)], np.uint64))
    out = np.zeros(1, np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return int(out.view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Bit i: parity of the number of elements hashed to i. Two sketches differ in at most as many bits
    as the sets differ in elements; halving a sketch by xor keeps that."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    place = (mix(s ^ np.uint64(0x5DEECE66D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def halved(words: np.ndarray) -> np.ndarray:
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def may_link(n1: int, s1: bytes, n2: int, s2: bytes) -> bool:
    a, b = np.frombuffer(s1, np.uint64), np.frombuffer(s2, np.uint64)
    while len(a) > len(b):
        a = halved(a)
    while len(b) > len(a):
        b = halved(b)
    return 4 * min(n1, n2) >= 3 * max(n1, n2) and 7 * int(np.bitwise_count(a ^ b).sum()) <= n1 + n2


class Neighbours:
    """Sketches of many sets, by sketch length, to ask which may link with one of them."""

    def __init__(self, sizes: np.ndarray, sketches: list[bytes]) -> None:
        self.sizes, self.sketches = sizes, sketches
        lengths = np.array([len(s) // 8 for s in sketches])
        self.by_length = {}
        for k in np.unique(lengths):
            index = np.flatnonzero(lengths == k)
            words = np.frombuffer(b"".join(sketches[i] for i in index), np.uint64).reshape(len(index), k)
            self.by_length[int(k)] = (index, words, halved(words) if k > 1 else words)

    def of(self, n: int, own: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the sets that may link with a set of ``n`` elements, and how far their sketches are."""
        row = np.frombuffer(own, np.uint64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in (len(row) // 2, len(row), len(row) * 2):
            if k in self.by_length:
                index, words, half = self.by_length[k]
                differ = words ^ row if k == len(row) else words ^ halved(row) if k < len(row) else half ^ row
                apart = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
                m = self.sizes[index]
                near = (4 * np.minimum(m, n) >= 3 * np.maximum(m, n)) & (7 * apart <= m + n)
                found.append((index[near], apart[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def as_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def document_sets(docs: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, h, n, c, sketch, shingles): hash of the text, size, class and sketch of the set, and for
    one row in ``SAMPLE_ONE_IN`` the set itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, sampled in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = shingles(text, WIDTH)
                rows.append((len(s), class_key(s), sketch(s) if len(s) else b"", s.view(np.int64) if sampled else None))
            own = as_batch(rows, ["n", "c", "sketch", "shingles"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own.columns], names=["doc_id", "h", "n", "c", "sketch", "shingles"])

    kind = dict(docs.dtypes)["doc_id"]
    text = text_or_empty()
    sampled = F.pmod(F.xxhash64(text), F.lit(max(1, min(SAMPLE_ONE_IN, n_docs // SAMPLE_DOCS)))) == 0
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.cast("binary").alias("text"), sampled.alias("sampled")).mapInArrow(
        run, f"doc_id {kind}, h long, n long, c long, sketch binary, shingles array<long>")


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def subset_count(n: int) -> int:
    return sum(comb(n, k) for k in range(-(-3 * n // 4), n + 1))


def boundary(sizes: dict[int, int]) -> int:
    """The largest size that enumerates subsets, by counted cost. ``sizes``: how many sets have each
    size up to ``LARGEST_SMALL``; larger sets cost the same wherever the boundary lies."""
    def cost(limit: int) -> float:
        return sum(k * ((subset_count(n) if n <= limit else 0) + (ENTRY_COST * prefix_length(n) if 4 * n > 3 * limit else 0))
                   for n, k in sizes.items() if n)

    return min(range(LARGEST_SMALL + 1), key=cost)


def frequent_shingles(sets: DataFrame) -> dict[int, int]:
    """Shingle hash -> rank (rarest first) of those that several sampled classes hold."""
    rows = (sets.where("shingles is not null").dropDuplicates(["c"]).select(F.explode("shingles").alias("token")).groupBy("token").count()
            .where(F.col("count") >= FREQUENT_AT).orderBy(F.desc("count"), "token").limit(FREQUENT).collect())
    return {r["token"]: len(rows) - k for k, r in enumerate(rows)}


def keys_of(docs: DataFrame, limit: int, frequent: dict[int, int]) -> DataFrame:
    """(kind, key, c, n): kind 0, a list entry of a set above 3/4 of the boundary; kind k > 0, a subset
    of k elements of a set up to the boundary."""
    tokens = np.array(sorted(frequent), dtype=np.int64)
    ranks = np.array([frequent[t] for t in tokens.tolist()], dtype=np.int64)

    def prefix(s: np.ndarray) -> np.ndarray:
        signed = s.view(np.int64)
        place = np.searchsorted(tokens, signed)
        rank = np.zeros(len(s), np.int64)
        if len(tokens):
            hit = tokens[np.minimum(place, len(tokens) - 1)] == signed
            rank[hit] = ranks[np.minimum(place, len(tokens) - 1)][hit]
        return signed[np.argsort(rank, kind="stable")[: prefix_length(len(s))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()  # classes this task has given out: copies of a document add nothing
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            kinds, keys, classes, sizes = [], [], [], []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(text, WIDTH)
                n = len(s)
                got = []
                if 4 * n > 3 * limit and n:
                    got.append((0, prefix(s)))
                if 0 < n <= limit:
                    x = mix(s)
                    for k in range(-(-3 * n // 4), n + 1):
                        subsets = np.array(list(combinations(range(n), k)))
                        got.append((k, mix(np.bitwise_xor.reduce(x[subsets], axis=1)).view(np.int64)))
                name = class_key(s) if got else 0
                if name in given:
                    continue
                if len(given) < REMEMBERED:
                    given.add(name)
                for k, key in got:
                    kinds.append(np.full(len(key), k, np.int32))
                    keys.append(key)
                    classes.append(np.full(len(key), name, np.int64))
                    sizes.append(np.full(len(key), n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, keys, classes, sizes)],
                                                 names=["kind", "key", "c", "n"])

    return docs.select(F.lit(0).alias("c"), text_or_empty().cast("binary").alias("text")).mapInArrow(
        run, "kind int, key long, c long, n long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows of keys that different classes share, once per class, with ``members`` (classes per key) and ``lo``, the least of
    them. Of keys with the same members (told by count, xor and sum of hashes) the smallest stands for all: near copies
    share hundreds."""
    of_key = Window.partitionBy("kind", "key")
    rows = keys.withColumn("lo", F.min("c").over(of_key)).withColumn("hi", F.max("c").over(of_key)).where("lo != hi")
    rows = rows.groupBy("kind", "key", "lo", "c").agg(F.first("n").alias("n"))
    rows = rows.withColumn("members", F.count("*").over(of_key)).withColumn("xor", F.bit_xor(F.xxhash64("c")).over(of_key)).withColumn(
        "sum", F.sum(F.shiftright(F.xxhash64("c", F.lit(7)), 32)).over(of_key))
    return rows.groupBy("kind", "members", "lo", "xor", "sum", "c").agg(F.min("key").alias("key"), F.first("n").alias("n")).drop("xor", "sum")


def subset_links(shared: DataFrame) -> DataFrame:
    """Links of small sets: to the smallest set that has the subset, where sizes allow."""
    rows = shared.where("kind > 0")
    least = rows.groupBy("kind", "key").agg(F.min("n").alias("m")).join(rows, ["kind", "key"]).where("n = m").groupBy(
        "kind", "key", "m").agg(F.min("c").alias("b"))
    return rows.join(least, ["kind", "key"]).where("c != b and 7 * kind >= 3 * (n + m)").select(F.col("c").alias("a"), "b")


def short_list_pairs(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes in short lists that sizes and sketches allow."""
    rows = shared.where(f"kind = 0 and members <= {SHORT}").select("key", "c", "n")
    other = rows.select("key", F.col("c").alias("b"), F.col("n").alias("m"))
    pairs = rows.join(other, "key").where("c < b and 4 * n >= 3 * m and 4 * m >= 3 * n").select(F.col("c").alias("a"), "b").distinct()
    both = pairs.join(classes.select(F.col("c").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("s1")), "a").join(
        classes.select(F.col("c").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2")), "b").select("a", "b", "n1", "s1", "n2", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def bundle_blocks(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the lists too long to give their pairs, with their sketches. Lists with the same least member are one
    bundle, with each member once: the hundreds of lists that near copies share differ by a few members. Bundles are
    dealt into pairs of blocks (one pair up to ``BLOCK`` members)."""
    rows = shared.where(f"kind = 0 and members > {SHORT}").select(F.col("lo").alias("key"), "c").distinct()
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks")
    return rows.join(classes.select("c", "n", "sketch"), "c")


def open_blocks(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """The blocks of bundles whose members lie in several components, with ``root``; the others can add nothing."""
    rooted = blocks.select("key", "c").distinct().join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
    return blocks.join(rooted.join(mixed, "key"), ["key", "c"])


def star_cover(blocks: DataFrame) -> DataFrame:
    """For every set of a block pair one neighbour that may link with it, if there is any."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c").reset_index(drop=True)
        names, own = group["c"].to_numpy(), group["own"].to_numpy()
        sizes, sketches = group["n"].to_numpy(), group["sketch"].tolist()
        across = group["lo"][0] != group["hi"][0]
        near = Neighbours(sizes, sketches)
        free = np.ones(len(names), dtype=bool)
        out = []
        for i in range(len(names)):
            if across and own[i] != group["lo"][0] or not across and not free[i]:
                continue
            found, _ = near.of(int(sizes[i]), sketches[i])
            found = found[free[found] & (found != i) & (~np.bool_(across) | (own[found] != own[i]))]
            free[found] = False
            out += [(names[i], names[j]) for j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return blocks.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pairs_apart(blocks: DataFrame, most: int) -> DataFrame:
    """Pairs of a block pair (of ``open_blocks``) that may link and lie in different components: for each set outside the
    block's largest component its ``most`` nearest ones. A set that has more gives the row (c, c)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c").reset_index(drop=True)
        names, own = group["c"].to_numpy(), group["own"].to_numpy()
        _, root, members = np.unique(group["root"].to_numpy(), return_inverse=True, return_counts=True)
        sizes, sketches = group["n"].to_numpy(), group["sketch"].tolist()
        across = group["lo"][0] != group["hi"][0]
        out = []
        near = Neighbours(sizes, sketches) if len(members) > 1 else None
        for i in np.flatnonzero(root != members.argmax()) if near else ():
            found, apart = near.of(int(sizes[i]), sketches[i])
            there = root[found] != root[i]
            if across:
                there &= own[found] != own[i]
            found, apart = found[there], apart[there]
            if len(found) > most:
                found = found[np.lexsort((names[found], apart))[:most]]
                out.append((names[i], names[i]))
            out += [(names[i], names[j]) for j in found]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return blocks.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of classes whose sets really link, by the whole texts."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes.select("c", "h"), "c"), "wanted")
    residues = wanted.select(F.pmod("h", F.lit(RESIDUES)).alias("r")).distinct()  # at most RESIDUES rows
    texts = docs.select(text_or_empty().cast("binary").alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    texts = texts.withColumn("r", F.pmod("h", F.lit(RESIDUES))).join(F.broadcast(residues), "r", "left_semi")
    texts = stored(texts.join(wanted, "h").groupBy("c").agg(F.any_value("text").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("t1")), "a").join(
        texts.select(F.col("c").alias("b"), F.col("text").alias("t2")), "b").select("a", "b", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}

        def of(c: int, text: pa.Scalar) -> np.ndarray:
            if c not in last:
                if len(last) >= 64:
                    last.clear()
                last[c] = shingles(text.as_py(), WIDTH)
            return last[c]

        for batch in batches:
            keep = []
            for a, b, t1, t2 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = of(a, t1), of(b, t2)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(7 * common >= 3 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document's set, and (node, root) of every class that has a link."""
    sets = stored(document_sets(docs, docs.count()), "sets")
    some = sets.where("n > 0")
    classes = stored(some.groupBy("c").agg(F.first("n").alias("n"), F.min("h").alias("h"), F.any_value("sketch").alias("sketch")), "classes")
    sizes = {r["n"]: r["count"] for r in classes.where(f"n <= {LARGEST_SMALL}").groupBy("n").count().collect()}
    frequent = frequent_shingles(sets)
    shared = stored(shared_keys(keys_of(docs, boundary(sizes), frequent)), "shared-keys")
    blocks = stored(bundle_blocks(shared, classes), "blocks")
    first = stored(short_list_pairs(shared, classes).union(star_cover(blocks)).distinct(), "pairs")
    links = stored(subset_links(shared).union(verified(first, docs, classes)), "links")
    roots = stored(components(links), "roots")
    # what is still apart: nearest first, more of them each time, until every allowed pair is tested
    tested, most = first, FIRST_NEAREST
    while True:
        found = stored(pairs_apart(open_blocks(blocks, roots), most), "pairs-apart")
        rest = stored(found.where("a < b").join(tested, ["a", "b"], "left_anti"), "pairs-untested")
        if rest.limit(1).count():
            links = stored(links.union(verified(rest, docs, classes)), "links")
            roots = stored(components(links), "roots")
            tested = tested.union(rest)
        if not found.where("a = b").limit(1).count():
            break  # every allowed pair was there; merging components only takes pairs away
        most *= 128
    return sets, roots


def with_roots(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n, c, root): the documents' sets (``h``: xxhash64 of the text) with their component."""
    sets, roots = linked(docs)
    return stored(sets.drop("sketch", "shingles").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")), "rooted")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    named = with_roots(docs)
    ids = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component"))
    return named.join(ids, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of every component the one with the smallest
    (doc_id, text hash), and all rows without words."""
    named = with_roots(docs)
    staying = named.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("k"))
    staying = stored(staying.select(F.col("k.doc_id").alias("_id"), F.col("k.h").alias("_h")).union(
        named.where("n = 0").select("doc_id", "h").distinct()), "staying")
    same = docs["doc_id"].eqNullSafe(staying["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == staying["_h"])
    rows = docs.join(staying, same, "left_semi")
    if named.where("n > 0").groupBy("doc_id", "h").count().where("count > 1").limit(1).count():  # repeated rows
        some = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        rows = rows.where(some).dropDuplicates(["doc_id", "text"]).union(rows.where(~some))
    return rows
