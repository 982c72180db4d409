"""Operator 1, removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if some string of ``DEPTH`` bytes that covers it also starts earlier (in a smaller doc_id,
or further left in the same document). Strings are judged on the input; overlaps count; matches never
cross documents. That needs the order of suffixes only through their first ``DEPTH`` bytes, sorted by
most-significant-digit passes that carry on with groups of two or more only:

1. *First digit.* Of the 32-byte grams inside a string the one with the smallest hash (leftmost on
   ties) is its anchor: a function of the string's bytes alone, so equal strings have equal anchors
   at equal places, and neighbouring strings mostly share one. The strings of a document are thus
   runs with one anchor each, a few hundredths as many as there are bytes. Runs are grouped by the
   gram; a gram met once holds unique strings only and leaves the sort.
2. *Second digit.* Runs of a gram are told apart by all bytes they cover. Equal runs are equal string
   by string, so all but the first are repeats. If a gram has one kind of run it is done.
3. *Last digit.* For grams with several kinds of run (edges of repeats), the first run of each kind
   falls into its single strings, grouped by their ``DEPTH`` bytes. Equal groups are exactly the
   repeated windows.

Digits are 64-bit hashes, two of them to a group, so a wrong match is out of practical reach.
No pass lists pairs. The second pass holds the runs of a gram in one sorted, spillable window. The
third moves the bytes of the runs to their gram and takes them apart in its task, up to ``LARGE`` runs;
a gram met more often (a passage that a third of all documents hold) goes through an aggregate with
map-side combine and a join back that adaptive execution may split.

Null texts are empty, texts shorter than ``DEPTH`` stay whole. A null doc_id sorts last. Rows with the
same doc_id and text are one document: none is earlier than the other, and both lose the same bytes. Very
long texts are handled whole; empty tables give empty results. Further columns travel in one struct, so
names that the operator uses itself don't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored, text_or_empty
from .hashing import mix, prefix_sums, window_hash

DEPTH = 100
GRAM = 32
#: bytes looked at together; places inside fit the low bits of a sort key
CHUNK = (1 << 18) - 256
#: bytes of texts whose runs are gathered before they are given out
GATHERED = 1 << 22
PLACE = np.uint64((1 << 20) - 1)
#: a run's place and length in one number: start * RUN + (strings - 1)
RUN = 128
LAST = (1 << 63) - 1
#: grams met more often than this are taken apart on the whole cluster, not in one task
LARGE = 20_000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def chunks(texts: list[bytes], depth: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """Texts dealt into chunks of (text, first byte, end byte, place in the chunk); a text longer than a
    chunk is cut so that every string lies in one part."""
    now: list[tuple[int, int, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at >= depth:
            end = min(len(text), at + CHUNK)
            if size + end - at > CHUNK:
                yield now
                now, size = [], 0
            now.append((i, at, end, size))
            size += end - at
            at = end if end == len(text) else end - depth + 1
    if now:
        yield now


def runs(texts: list[bytes], depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: (text, start * RUN + strings - 1, gram hash, run hash)."""
    out: list[tuple[np.ndarray, ...]] = []
    width = depth - gram + 1
    for parts in chunks(texts, depth):
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b, _ in parts), dtype=np.uint8)
        sums = prefix_sums(data)
        place = np.arange(len(data) - gram + 1)
        grams = window_hash(sums, place, place + gram)
        key = (grams & ~PLACE) | place.astype(np.uint64)
        anchor = (sliding_min(key, width) & PLACE).astype(np.int64)
        offset = np.array([o for *_, o in parts])
        own = np.zeros(len(anchor), dtype=bool)  # strings that don't cross into the next text
        for _, a, b, o in parts:
            own[o : o + b - a - depth + 1] = True
        start = np.flatnonzero(own)
        at = anchor[start]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        s0, s1 = start[first], start[np.append(first[1:], len(start)) - 1]
        part = np.searchsorted(offset, s0, side="right") - 1
        shape = ((at[first] - s0) * RUN + (s1 - s0)).astype(np.uint64)
        whole = mix(window_hash(sums, s0, s1 + depth) + shape * np.uint64(0x9E3779B97F4A7C15))
        text = np.array([i for i, *_ in parts])[part]
        begin = s0 - offset[part] + np.array([a for _, a, _, _ in parts])[part]
        out.append((text, begin * RUN + (s1 - s0), grams[at[first]], whole))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def first_of_each(text: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Indices of the first place of every (text, a, b), and the later places of each as lists."""
    order = np.lexsort((place, b, a, text))
    t, x, y = text[order], a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    counts = np.diff(np.append(new, len(order)))
    later = np.ones(len(order), dtype=bool)
    later[new] = False
    offsets = np.concatenate([[0], np.cumsum(counts - 1)])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(place[order][later], pa.int64()))
    return order[new], lists.cast(pa.list_(pa.int64()))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``GATHERED`` bytes of a binary column."""
    for batch in batches:
        filled = np.cumsum(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)) // GATHERED
        ends = np.append(np.flatnonzero(filled[1:] != filled[:-1]) + 1, batch.num_rows) if batch.num_rows else []
        start = 0
        for end in ends:
            yield batch.slice(start, end - start)
            start = end


def run_rows(docs: DataFrame) -> DataFrame:
    """First pass input: one row per document and kind of run."""
    names = ["gram", "run", "_id", "_ver", "place", "again"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            text, place, gram, whole = runs(batch.column(2).to_pylist())
            if len(text):
                one, again = first_of_each(text, place, gram, whole)
                yield pa.RecordBatch.from_arrays(
                    [signed(gram[one]), signed(whole[one]), pa.array(ids[text[one]]), pa.array(versions[text[one]]),
                     pa.array(place[one], pa.int64()), again], names=names)

    return docs.select("_id", "_ver", F.col("_text")).mapInArrow(
        scan, "gram long, run long, _id long, _ver long, place long, again array<long>")


def marks(docs: DataFrame) -> DataFrame:
    """First and second pass, per document: ``cuts`` (runs that go), ``ask`` (runs to take apart, with
    their gram) and ``ask_large`` (those of grams met more than ``LARGE`` times)."""
    rows = run_rows(docs)
    of_gram, of_run = Window.partitionBy("gram"), Window.partitionBy("gram", "run")
    rows = rows.withColumn("n", F.count("*").over(of_gram)).withColumn("lo", F.min("run").over(of_gram)).withColumn(
        "hi", F.max("run").over(of_gram)).where((F.col("n") > 1) | (F.size("again") > 0))
    rows = rows.withColumn("later", F.col("_id") > F.min("_id").over(of_run))
    rows = rows.withColumn("mixed", ~F.col("later") & (F.col("lo") != F.col("hi")))
    rows = rows.where(F.col("later") | F.col("mixed") | (F.size("again") > 0))
    return rows.groupBy("_id", "_ver").agg(
        F.flatten(F.collect_list(F.when(F.col("later"), F.array_append("again", F.col("place"))).otherwise(F.col("again")))).alias("cuts"),
        F.collect_set(F.when(F.col("mixed") & (F.col("n") <= LARGE), F.struct("place", "gram"))).alias("ask"),
        F.collect_set(F.when(F.col("mixed") & (F.col("n") > LARGE), F.col("place"))).alias("ask_large"))


def run_texts(asked: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Third pass input: the runs in ``ask`` with the bytes they cover."""
    names = ["gram", "_id", "_ver", "place", "bytes"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = [a["place"] for a in row["ask"]]
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a["gram"] for a in row["ask"]], pa.int64()), pa.array([row["_id"]] * n, pa.int64()),
                     pa.array([row["_ver"]] * n, pa.int64()), pa.array(places, pa.int64()),
                     pa.array([row["_text"][p // RUN : p // RUN + p % RUN + depth] for p in places], pa.binary())], names=names)

    return asked.mapInArrow(scan, "gram long, _id long, _ver long, place long, bytes binary")


def later_strings(batch: pa.RecordBatch, depth: int = DEPTH) -> pa.RecordBatch:
    """Cuts for the strings of whole gram groups that also start earlier."""
    gram, ids, versions, place = (batch.column(i).to_numpy() for i in range(4))
    data = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8)
    many = place % RUN + 1
    begin = np.concatenate([[0], np.cumsum(many + depth - 1)[:-1]])
    row = np.repeat(np.arange(len(place)), many)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[row] + inside
    string = np.empty(len(row), np.uint64)
    for a in range(0, len(at), 1 << 18):  # sums over at most some tens of MB at once
        part = at[a : a + (1 << 18)]
        low, high = part[0], part[-1] + depth
        string[a : a + len(part)] = window_hash(prefix_sums(data[low:high]), part - low, part - low + depth)
    start = place[row] // RUN + inside
    order = np.lexsort((start, versions[row], ids[row], string, gram[row]))
    g, w, i, v = gram[row][order], string[order], ids[row][order], versions[row][order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
    least = i[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    again = np.concatenate([[False], ~new[1:] & (i[1:] == i[:-1]) & (v[1:] == v[:-1]) & (start[order][1:] != start[order][:-1])])
    gone = np.zeros(len(row), dtype=bool)
    gone[order] = (i > least) | again
    # neighbouring strings of a run go as one cut
    head = gone & ~np.concatenate([[False], gone[:-1] & (row[1:] == row[:-1])])
    tail = gone & ~np.concatenate([gone[1:] & (row[1:] == row[:-1]), [False]])
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[row[first]]), pa.array(versions[row[first]]), pa.array(start[first] * RUN + last - first)], names=["_id", "_ver", "cut"])


def cut_strings(texts: DataFrame) -> DataFrame:
    """Third pass: gram by gram, the strings of the runs that also start earlier (at most ``LARGE`` runs
    of a gram, so a group fits its task)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            gram = batch.column(0).to_numpy()
            if not len(gram):
                continue
            ends = np.flatnonzero(gram != gram[-1])
            open_from = ends[-1] + 1 if len(ends) else 0  # the last group may go on in the next batch
            if kept and gram[0] != kept[-1].column(0)[-1].as_py():
                yield later_strings(pa.concat_batches(kept))
                kept = []
            if open_from:
                yield later_strings(pa.concat_batches([*kept, batch.slice(0, open_from)]))
                kept = []
            kept.append(batch.slice(open_from))
        if kept:
            yield later_strings(pa.concat_batches(kept))

    return texts.repartition("gram").sortWithinPartitions("gram").mapInArrow(scan, "_id long, _ver long, cut long")


def string_rows(asked: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Single strings of the runs in ``ask_large``, first places per document."""
    names = ["s1", "s2", "_id", "_ver", "place", "again"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sums = prefix_sums(np.frombuffer(row["_text"], dtype=np.uint8))
                start = np.unique(np.concatenate([np.arange(p // RUN, p // RUN + p % RUN + 1) for p in row["ask_large"]]))
                whole, half = window_hash(sums, start, start + depth), window_hash(sums, start, start + depth // 2)
                one, again = first_of_each(np.zeros(len(start), np.int64), start, whole, half)
                yield pa.RecordBatch.from_arrays(
                    [signed(whole[one]), signed(half[one]), pa.array([row["_id"]] * len(one), pa.int64()),
                     pa.array([row["_ver"]] * len(one), pa.int64()), pa.array(start[one], pa.int64()), again], names=names)

    return asked.mapInArrow(scan, "s1 long, s2 long, _id long, _ver long, place long, again array<long>")


def cut_large(asked: DataFrame) -> DataFrame:
    """Third pass for grams met very often: an aggregate with map-side combine and a join back, both
    safe for a string that a third of all documents hold."""
    strings = string_rows(asked)
    known = strings.groupBy("s1", "s2").agg(F.min("_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = strings.join(known, ["s1", "s2"], "left")
    later = F.coalesce(F.col("_id") > F.col("first"), F.lit(False))
    gone = F.when(later, F.array_append("again", F.col("place"))).otherwise(F.col("again"))
    return found.select("_id", "_ver", F.explode(gone).alias("place")).select("_id", "_ver", (F.col("place") * RUN).alias("cut"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (any columns, with ``_id``, ``_ver`` and ``_text``) and the cuts of each."""
    marked = stored(marks(docs), "repeat-marks")
    texts = docs.select("_id", "_ver", "_text")
    asked = texts.join(marked.where(F.size("ask") > 0).select("_id", "_ver", "ask"), ["_id", "_ver"])
    found = cut_strings(run_texts(asked))
    if marked.where(F.size("ask_large") > 0).limit(1).count():
        large = texts.join(marked.where(F.size("ask_large") > 0).select("_id", "_ver", "ask_large"), ["_id", "_ver"])
        found = found.union(cut_large(large))
    found = found.groupBy("_id", "_ver").agg(F.collect_list("cut").alias("cuts"))
    cuts = marked.select("_id", "_ver", "cuts").unionByName(found).groupBy("_id", "_ver").agg(
        F.flatten(F.collect_list("cuts")).alias("_cuts"))
    return docs.join(cuts, ["_id", "_ver"], "left")


def merged(cuts: list[int], depth: int = DEPTH) -> list[tuple[int, int]]:
    """Maximal removed spans of runs given as start * RUN + strings - 1."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((p // RUN, p // RUN + p % RUN + depth) for p in cuts):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def cut_rows(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """(row, kept, spans): every row of ``docs`` as one struct, its remaining bytes, and what went. With
    ``as_text`` kept is a string, without the characters that lost part of their bytes."""
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("_id"),
                      F.crc32(text).alias("_ver"), text.cast("binary").alias("_text"))
    rows = repeated_spans(own).select("row", "_text", "_cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "_text"):
            kept, spans = [], []
            for text, cuts in zip(batch.column("_text").to_pylist(), batch.column("_cuts").to_pylist(), strict=True):
                gone = merged(cuts) if cuts else []
                ends = [0, *(e for _, e in gone)]
                starts = [*(s for s, _ in gone), len(text)]
                left = b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)) if gone else text
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                spans.append([{"start": s, "end": e} for s, e in gone])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, kind)],
                                             names=["row", "kept", "spans"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return rows.mapInArrow(cut, T.StructType([*rows.select("row").schema.fields, T.StructField(
        "kept", T.StringType() if as_text else T.BinaryType()), T.StructField("spans", T.ArrayType(span))]))


def without_repeats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns of ``docs`` with ``kept`` (the remaining bytes) and ``spans`` (what went)."""
    need = docs.select(*dict.fromkeys([*columns, "doc_id", "text"]))
    return cut_rows(need).select(*[F.col("row").getField(c).alias(c) for c in columns], "kept", "spans")


def without_repeated_text(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with the repeated bytes taken out of ``text``; a character that lost part of
    its bytes goes too, and ``n_chars`` follows where there is such a column. Null texts stay null."""
    rows = cut_rows(docs, as_text=True)
    old = lambda c: F.col("row").getField(c)
    text = F.when(old("text").isNotNull(), F.col("kept"))
    return rows.select(*[text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else
                         old(c).alias(c) for c in docs.columns])
