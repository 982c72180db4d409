"""Operator 12, spelling variants of words grouped by a trie-node pair dictionary.

Words are counted over whole texts. Then the words' trie is numbered, and the trie of the reversed
words: a word of length L becomes L + 1 prefix nodes and L + 1 suffix nodes (integers). The pair
(prefix node, suffix node) around a skipped position i, (P[i], S[i + 1]), is shared by exactly the
words that differ there, and it equals the pair (P[i], S[i]) of the word that lacks that position. So
one grouping of integer pairs gives all neighbours at distance one, exactly: replaced code points
meet skipped with skipped, inserted and deleted ones meet skipped with whole.

A pair's group has at most one word per letter of the alphabet (90), plus the one without a letter,
so it is bounded; neighbours are counted per group, not listed as pairs. Two words that differ by one
replacement share one skipped pair only. Deleting any letter of a run of equal letters gives the
same word, so only the first of a run counts.

Numbering is one pass over sorted words. Splitters (bounded sample, ``SAMPLE``; they only balance the
parts) cut the order into parts. A node whose words lie in several parts is a prefix of a splitter,
and those few are numbered beforehand; all others belong to one part and get its number and a running
one. A part streams through its task with one word's nodes in memory.

Nulls and empty texts have no words. Repeated rows and copies count each time. A null doc_id hashes
as the empty text. Very long texts are cut into words slice by slice; very long words have long node
arrays, nothing quadratic. Empty tables give empty results. Only ``doc_id`` and ``text`` are read, so
further columns, whatever their names, neither disturb nor return.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: least code points and occurrences of a word, the modulus of the damage, how much commoner a form must be
LEAST_LENGTH, LEAST_COUNT, DAMAGE, RATIO = 5, 3, 97, 2
#: words sampled for the splitters, code points kept of one, words aimed at per part
SAMPLE, SPLITTER_LENGTH, PART_WORDS = 8192, 32, 50_000
#: bytes of a text cut into words at once, distinct words a task holds before it sends them on
SLICE, HELD = 1 << 22, 300_000
#: Latin-1 byte -> itself inside a word (A-Z as a-z), a space elsewhere
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Iterator[Counter]:
    """Lower-cased runs of letters (A-Z, a-z, U+00C0 to U+00FF) of a text as Latin-1 bytes, counted slice by slice."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if len(data) - at > SLICE else -1
        end = len(data) if end < 0 else end
        yield Counter(data[at:end].split())
        at = end


def damaged(prefix: int, run: bytes, modulus: int) -> bytes:
    """The run without one code point, if ``modulus`` divides the CRC of ``<doc_id>:<run>``; ``prefix`` is the CRC
    of ``<doc_id>:``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points with at least ``least_count`` occurrences. One of
    ``damage`` runs loses a code point (0: none does)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for part in runs(text.as_py()):
                    for run, n in part.items():
                        if damage:
                            run = damaged(prefix, run, damage)
                        if len(run) >= least_length:
                            held[run] += n
                if len(held) > HELD:
                    yield batch_of()
                    held.clear()
        if held:
            yield batch_of()

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def splitters(words: DataFrame) -> list[str]:
    """Sorted beginnings of words that cut ``words`` (word) into parts of about ``PART_WORDS``, from the ``SAMPLE``
    words of the smallest hashes."""
    total = words.count()
    sample = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select(F.substring("word", 1, SPLITTER_LENGTH).alias("w")).collect()
    found = sorted(r["w"] for r in sample)
    parts = min(len(found), -(-total // PART_WORDS))
    return sorted({found[k * len(found) // parts] for k in range(1, parts)}) if parts > 1 else []


def numbered(words: DataFrame) -> DataFrame:
    """(word, place, nodes): ``words`` (word, distinct) with their place in code-point order (increasing, not gapless)
    and the numbers of the trie nodes of their prefixes of 0..L code points."""
    cuts = splitters(words)
    shared = {p: -i - 1 for i, p in enumerate(sorted({c[:k] for c in cuts for k in range(len(c) + 1)} | {""}))}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(cuts, w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.int64())], names=["word", "part"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, stack, place, node = None, "", [], 0, 0
        for batch in batches:
            places, nodes = [], []
            words = batch.column(0).to_pylist()
            for word, part in zip(words, batch.column(1).to_pylist(), strict=True):
                if part != now:
                    now, before, stack, place, node = part, "", [shared[""]], part << 40, part << 40
                same, most = 0, min(len(word), len(before))
                while same < most and word[same] == before[same]:
                    same += 1
                del stack[same + 1 :]
                for k in range(same + 1, len(word) + 1):
                    number = shared.get(word[:k]) if k <= SPLITTER_LENGTH else None
                    if number is None:
                        number, node = node, node + 1
                    stack.append(number)
                places.append(place)
                nodes.append(stack.copy())
                place, before = place + 1, word
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))],
                                             names=["word", "place", "nodes"])

    dealt = words.select("word").mapInArrow(deal, "word string, part long")
    return dealt.repartition("part").sortWithinPartitions("part", "word").mapInArrow(number, "word string, place long, nodes array<long>")


def _reversed(name: str) -> Column:
    return F.reverse(F.col(name))


def pair_rows(words: DataFrame) -> DataFrame:
    """(p, s, place, n, kind) of ``words`` (word, n, place, nodes, ends): kind 2 is the whole word around a position, 1 a
    skipped position that is the first of its run of equal letters, 0 any other skipped one."""
    size = F.length("word")
    ends = lambda i: F.get("ends", size - i)  # noqa: E731  node of the suffix from i on
    first = lambda i: (F.substring("word", i + 1, 1) != F.substring("word", i, 1)) | (i == 0)
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("nodes", i).alias("p"), ends(i + 1).alias("s"), first(i).cast("int").alias("kind")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("nodes", i).alias("p"), ends(i).alias("s"), F.lit(2).alias("kind")))
    return words.select("place", "n", F.inline(F.concat(skipped, whole)))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(place, n_near, best) from ``pair_rows``; best is the struct (n, earlier place first) of the commonest near word."""
    member = F.struct("n", (-F.col("place")).alias("back"), "kind")
    groups = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("all")).where("size(all) > 1")
    skipped = F.filter("all", lambda m: m["kind"] < 2)
    best = lambda m: F.struct(m["n"].alias("n"), m["back"].alias("back"))
    of = groups.select("all", skipped.alias("skipped"), F.get(F.filter("all", lambda m: m["kind"] == 2), F.lit(0)).alias("whole"),
                       F.filter("all", lambda m: m["kind"] == 1).alias("longer")).where("size(skipped) > 0")

    def seen_by_skipped(m: Column) -> Column:
        other = F.when(F.get("skipped", F.lit(0))["back"] == m["back"], F.get("skipped", F.lit(1))).otherwise(F.get("skipped", F.lit(0)))
        shorter = F.when(m["kind"] == 1, F.col("whole"))
        return F.struct((-m["back"]).alias("place"), (F.size("skipped") - 1 + shorter.isNotNull().cast("int")).cast("long").alias("near"),
                        F.greatest(F.when(other.isNotNull(), best(other)), F.when(shorter.isNotNull(), best(shorter))).alias("best"))

    longest = F.get("longer", F.lit(0))
    seen_by_whole = F.struct((-F.col("whole.back")).alias("place"), F.size("longer").cast("long").alias("near"),
                             F.when(longest.isNotNull(), best(longest)).alias("best"))
    rows = of.select(F.inline(F.concat(F.transform("skipped", seen_by_skipped),
                                       F.when(F.col("whole").isNotNull(), F.array(seen_by_whole)).otherwise(F.array()))))
    return rows.where("near > 0").groupBy("place").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(place, root) from ``forms`` (place, form): the end of each chain, found by doubling the steps. A form is at least
    twice as common as its word, so chains are no longer than the logarithm of the largest count."""
    now = stored(forms.select("place", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("place").alias("root"), F.col("root").alias("_next"))
        step = now.join(further, "root", "left").select("place", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        step = stored(step, "spelling-roots")
        if not step.where("moved").limit(1).count():
            return step.select("place", "root")
        now = step.select("place", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE,
             ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word: ``form`` is its commonest near word (ties: the smallest) if
    that is ``ratio`` times as common as the word, ``root`` the end of the chain of forms."""
    counts = stored(word_counts(docs, least_length, least_count, damage), "spelling-words")
    ahead = numbered(counts)
    back = numbered(counts.select(_reversed("word").alias("word"))).select(_reversed("word").alias("word"), F.col("nodes").alias("ends"))
    words = stored(counts.join(ahead, "word").join(back, "word"), "spelling-nodes")
    # a word becomes some twenty pairs: spread the few files of the node table over all tasks first
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = neighbours(pair_rows(words.repartition(spread, "place")))
    names = words.select(F.col("place").alias("_place"), F.col("word").alias("_word"))
    known = words.select("word", "n", "place").join(near, "place", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    known = stored(known.select("word", "n", "place", "n_near", F.when(F.col("best.n") >= ratio * F.col("n"), F.struct(
        (-F.col("best.back")).alias("place"), F.col("best.n").alias("n"))).alias("form")), "spelling-near")
    chained = known.where("form is not null").select("place", F.col("form.place").alias("form"))
    ends = known.select("word", "n", "n_near", "place", F.col("form.place").alias("form"), F.col("form.n").alias("form_n")).join(
        roots(chained), "place", "left")
    named = ends.join(names.withColumnRenamed("_word", "form_word"), F.col("form") == F.col("_place"), "left").drop("_place")
    named = named.join(names.withColumnRenamed("_word", "root_word"), F.col("root") == F.col("_place"), "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
