"""Operator 9, packing token pieces into sequences by best-fit decreasing.

Every document becomes its token ids and an end id; a document longer than a sequence is first cut
into full windows, which leaves one piece shorter than a sequence. Pieces are then placed longest
first, each into the open sequence with the least room that still holds it; a segment tree indexed
by remaining room finds that room.

Best-fit decreasing sees lengths only, and there are at most ``room`` of them. So the driver plans on
the histogram of lengths (at most ``room`` rows, whatever the input): a run of equal pieces fills a
run of equally full sequences in one step. The plan says, per length and rank among the pieces of
that length, which sequence and offset a piece gets. Ranks are counted on the cluster per (length,
salt), so a length that most pieces share is not one task. Token ids never leave their piece row.

Nulls and empty texts have the end id only. Repeated rows are packed each. Cutting never loses an
id: pieces of a document are consecutive. Very long texts leave a task in bounded batches; empty tables give
empty results. Columns beyond doc_id and text, whatever their names, are not read by ``token_pieces``; ``pack`` keeps the
columns of its pieces, whose names must not be its own (sequence_id, offset).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty

ROOM = 2048
END_ID = 1
SALTS = 16
#: words and parts of words whose ids a task remembers
WORDS, PARTS = 100_000, 250_000
#: words of these characters alone fall into letters, single digits and runs of other signs
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ɏ]+")
PART = re.compile("[a-zß-öø-ɏ]+|[0-9]|[^a-zß-öø-ɏ0-9]+")

_TOKENIZERS: dict = {}


class PartIds(dict):
    """Pre-token (lower-cased letters, a digit, or a run of signs) -> its ids as little-endian uint32
    bytes, by the vocabulary's BPE model alone; the model's alphabet stands for bytes."""

    def __init__(self, model) -> None:  # noqa: ANN001
        self.tokenize = model.tokenize
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in own}
        self.alphabet |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in self.alphabet)}

    def __missing__(self, part: str) -> bytes:
        coded = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part.encode()))
        out = array("I", [t.id for t in self.tokenize(coded)]).tobytes()
        if len(self) < PARTS:
            self[part] = out
        return out


class WordIds(dict):
    """Word (UTF-8 bytes) -> its ids as little-endian uint32 bytes, encoded when first met. The
    vocabulary's pre-tokeniser never joins text over ASCII white space, so words are independent."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.parts = tokenizer.encode, PartIds(tokenizer.model)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower()  # of some capitals it lies outside the plain range
        if PLAIN.fullmatch(text) and (text.isascii() or PLAIN.fullmatch(low)) and "<|" not in text:
            out = b"".join(map(self.parts.__getitem__, PART.findall(low)))
        else:
            out = array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < WORDS:
            self[word] = out
        return out


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the documents' ids cut into windows of at most ``room``;
    ``ids`` are little-endian unsigned 32-bit numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("ids", pa.binary())])
    end, width = end_id.to_bytes(4, "little"), room * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = word_ids(tokenizer).__getitem__
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(lookup, text.as_py().split())) + end
                n = len(ids) // 4
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    for column, value in zip(rows, (doc_id, at // 4, len(part) // 4, n, part), strict=True):
                        column.append(value)
                size += len(ids)
                if size > 1 << 22:  # bounded batches, however long the texts
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, size = [[], [], [], [], []], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


class RoomTree:
    """Segment tree over 0..room: how many open sequences have each remaining room."""

    def __init__(self, room: int) -> None:
        self.size = 1 << room.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.sums[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some sequence has."""
        i = least + self.size
        if self.sums[i]:
            return least
        while i > 1:
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on a histogram of lengths. Rows (length, rank, sequence, each, offset): from
    ``rank`` on, the i-th piece further goes to sequence + i // each at offset + (i % each) * length."""
    tree, opened, out = RoomTree(room), 0, []
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)

    def keep(left: int, first: int, n: int) -> None:
        if n and left:
            runs.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:  # nothing open holds it: new sequences, as many as the rest needs
                left, first, n = room, opened, -(-todo // (room // length))
                opened += n
            else:
                first, n = runs[left].pop()
                tree.add(left, -n)
            each = left // length
            full = min(n, todo // each)
            placed = full * each
            part = min(todo - placed, each - 1) if full < n else 0
            out.append((length, rank, first, each, room - left))
            keep(left - each * length, first, full)
            if full < n:
                keep(left - part * length, first + full, 1)
                keep(left, first + full + 1, n - full - 1)
            todo -= placed + part
            rank += placed + part
    return out


def pack(pieces: DataFrame, room: int = ROOM, salts: int = SALTS) -> DataFrame:
    """``pieces`` (a stored table with doc_id, start, length and any more columns) with their
    ``sequence_id`` and ``offset``."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("c"))
    rows = counts.collect()  # at most room * salts rows
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for r in sorted(rows, key=lambda r: (r["length"], r["_salt"])):
        first[r["length"], r["_salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["c"]
    steps: dict[int, list] = {}
    for length, *step in plan(histogram, room):
        steps.setdefault(length, []).append(tuple(step))
    spark = pieces.sparkSession
    table = spark.createDataFrame(
        [(length, salt, n, steps[length]) for (length, salt), n in first.items()],
        "length long, _salt int, _first long, _steps array<struct<rank:long,sequence:long,each:long,offset:long>>")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start")) - 1
    out = salted.withColumn("_rank", rank).join(table, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    out = out.withColumn("_step", F.element_at(F.filter("_steps", lambda s: s["rank"] <= F.col("_rank")), -1))
    i = F.col("_rank") - F.col("_step.rank")
    return out.withColumn("sequence_id", F.col("_step.sequence") + F.expr("(_rank - _step.rank) div _step.each")).withColumn(
        "offset", F.col("_step.offset") + (i % F.col("_step.each")) * F.col("length")).drop(
        "_salt", "_rank", "_first", "_steps", "_step")
