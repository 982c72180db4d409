"""Operator 13, exact token counts of every prefix of a text by dynamic programming.

A byte-level BPE encoding has one possible last token at every place: the token t ending there for
which the pair (last token before t, t) stays apart when the two are encoded together. So one pass
over a text fills, place by place, ``count[i] = count[i - len(t)] + 1``. An Aho-Corasick automaton
over the vocabulary lists the tokens that end at a place; pairs already judged are remembered, and
so are the counts of frequent pieces (BPE never joins text across the pieces of the pre-tokeniser).

``counts[i]`` is the number of tokens of the first i code points taken as a text of its own. A
prefix may be cut into other pieces than the whole text, so three cases are put right: white space
before a word (a prefix that ends in a run of white space has the run as one piece), a contraction
of two letters cut in its middle, and the beginning of a special token's string.

``prefix_table`` keeps the counts in blocks, so that ``count_at`` and ``longest_prefix`` answer later
questions by a join or an aggregate, without a tokenizer. ``totals`` answers for whole texts and
budgets in the task and stores nothing.

Nulls and empty texts have 0 tokens. Repeated rows are counted each; rows that share a doc_id are told
apart by ``text_hash``. Very long texts are counted slice by slice (cut before white space); memory
holds one slice. Only ``doc_id`` and ``text`` are read: further columns, whatever their names, are
left out of the results. Empty tables give empty results.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: code points of a stored block, of a slice of a text, and of an output batch
BLOCK, SLICE, BATCH = 1 << 16, 1 << 20, 1 << 21
#: pieces whose counts, and pairs whose verdicts, a task remembers
PIECES, PAIRS = 400_000, 2_000_000
# Fixed values of the byte-level pre-tokeniser: its split pattern and its contractions of two letters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class PieceCounts(dict):
    """Piece of a text -> its counts at the end of each of its code points, as little-endian uint32 bytes."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.tokenize = tokenizer.model.tokenize
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = [t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]]
        self.alphabet = byte_alphabet()
        self.names: dict[int, str] = {}
        self.ends = ahocorasick.Automaton()
        for name, number in tokenizer.get_vocab(with_added_tokens=False).items():
            if name not in self.specials and [t.id for t in self.tokenize(name)] == [number]:
                self.names[number] = name
                self.ends.add_word(name, (number, len(name)))
        self.ends.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined text is encoded as just these two."""
        known = [t.id for t in self.tokenize(self.names[left] + self.names[right])] == [left, right]
        if len(self.apart) < PAIRS:
            self.apart[left, right] = known
        return known

    def by_byte(self, coded: str) -> list[int]:
        """Counts at every byte of a piece written in the byte alphabet; index 0 is the empty prefix."""
        count, last, apart = [0] * (len(coded) + 1), [-1] * (len(coded) + 1), self.apart
        for end, (token, size) in self.ends.iter(coded):
            end += 1
            if last[end] >= 0:
                continue
            if size < end:
                before = last[end - size]
                if before < 0:
                    continue
                known = apart.get((before, token))
                if not (self.stays_apart(before, token) if known is None else known):
                    continue
            last[end], count[end] = token, count[end - size] + 1
        return count

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            count = self.by_byte(piece.replace(" ", self.alphabet[32]))[1:]
        else:
            data = piece.encode()
            count = self.by_byte("".join(map(self.alphabet.__getitem__, data)))
            count = [count[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]  # ends of code points
        if piece in LONG_CONTRACTIONS:
            count[1] = 2  # cut in the middle, the apostrophe and the letter are pieces of their own
        out = array("I", count).tobytes()
        if len(self) < PIECES and len(piece) < 64:
            self[piece] = out
        return out


class PrefixCounter:
    """Exact token counts of all prefixes of texts, for the byte-level BPE tokenizer file at ``path``."""

    def __init__(self, path: str) -> None:
        import regex

        self.pieces = PieceCounts(path)
        self.split, self.runs = regex.compile(SPLIT).findall, regex.compile(r"\s{2,}(?=\S)").finditer
        self.cut = regex.compile(r"(?<=\S)\s").search
        self.special = regex.compile("|".join(map(regex.escape, self.pieces.specials))) if self.pieces.specials else None

    def pieces_of(self, text: str) -> list[str]:
        """The pre-tokeniser's pieces; texts with code points newer than this Python's tables go to the library."""
        if text.isascii() or all(unicodedata.category(c) != "Cn" for c in set(text)):
            return self.split(text)
        return [text[a:b] for _, (a, b) in self.pieces.split(text)]

    def plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0..len(text) code points, no special token in the text."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        parts = self.pieces_of(text)
        if not parts:
            return out
        within = np.frombuffer(b"".join(map(self.pieces.__getitem__, parts)), dtype="<u4")
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        whole = within[np.cumsum(size) - 1].astype(np.int64)
        out[1:] = within + np.repeat(np.cumsum(whole) - whole, size)
        for run in self.runs(text):
            a, b = run.span()
            out[b] = out[a] + int.from_bytes(self.pieces[run.group()][-4:], "little")
        return out

    def slice_counts(self, text: str) -> np.ndarray:
        """Like ``plain``, the special tokens' strings counted as the library does: one token each."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, base, at = [np.zeros(1, np.int64)], 0, 0
        for found in self.special.finditer(text):
            ahead = self.plain(text[at : found.end() - 1])  # up to the string's last character it is plain text
            out.append(base + ahead[1:])
            base += int(ahead[found.start() - at]) + 1
            out.append(np.array([base]))
            at = found.end()
        out.append(base + self.plain(text[at:])[1:])
        return np.concatenate(out)

    def stream(self, text: str, size: int = SLICE) -> Iterator[tuple[int, np.ndarray]]:
        """(first, counts): counts of the prefixes of first, first + 1, … code points; together 0..len(text)."""
        at, base = 0, 0
        while True:
            found = self.cut(text, at + size) if len(text) - at > size else None
            end = found.start() if found else len(text)
            counts = self.slice_counts(text[at:end]) + base
            yield (at, counts) if at == 0 else (at + 1, counts[1:])
            base, at = int(counts[-1]), end
            if not found:
                return


@lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text"))


def totals(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, fit_chars) per row of ``docs``: the whole text's exact tokens, and the
    code points of its longest prefix of at most ``budget`` tokens. ``tokenizer`` is a byte-level BPE file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        for batch in batches:
            chars, tokens, fits = [], [], []
            for text in batch.column(1):
                text, fit = text.as_py(), 0
                for first, counts in counter.stream(text):
                    if counts.min() <= budget:
                        fit = first + int(np.flatnonzero(counts <= budget)[-1])
                chars.append(len(text))
                tokens.append(int(counts[-1]))
                fits.append(fit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()),
                                              pa.array(fits, pa.int64())], names=["doc_id", "n_bytes", "n_chars", "n_tokens", "fit_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_chars long, n_tokens long, fit_chars long")


def prefix_table(docs: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, block, counts): ``counts[j]`` is the exact token count of the text's first
    block * ``block`` + j code points. Write it once; ``count_at`` and ``longest_prefix`` read it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer)
        names, kinds = ["doc_id", "text_hash", "block", "counts"], [None, pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            rows, held = [], 0
            for doc_id, text, text_hash in zip(*(batch.column(i) for i in range(3)), strict=True):
                pending, number = np.zeros(0, np.int64), 0
                for _, counts in counter.stream(text.as_py()):
                    pending = np.concatenate([pending, counts])
                    while len(pending) > block:  # the last block keeps at least one count
                        rows.append((doc_id.as_py(), text_hash.as_py(), number, pending[:block].astype(np.int32)))
                        pending, number, held = pending[block:], number + 1, held + block
                    if held > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                rows.append((doc_id.as_py(), text_hash.as_py(), number, pending.astype(np.int32)))
                held += len(pending)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        count, f"doc_id {kind}, text_hash long, block long, counts array<int>")


def count_at(table: DataFrame, questions: DataFrame, block: int = BLOCK) -> DataFrame:
    """``questions`` (doc_id, n_chars and any more columns) with ``n_tokens``, the exact token count of the document's
    first ``n_chars`` code points; null where the document is unknown, the place null, negative or past its end.
    A question about a doc_id of several texts gets a row for each."""
    place = F.expr(f"n_chars div {block}")
    asked = questions.withColumn("_block", place)
    known = table.select(F.col("doc_id").alias("_doc"), F.col("block").alias("_known"), "counts")
    joined = asked.join(known, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_block") == F.col("_known")), "left")
    at = F.when(F.col("n_chars") >= 0, F.get("counts", (F.col("n_chars") % block).cast("int")))
    return joined.withColumn("n_tokens", at.cast("long")).select(*questions.columns, "n_tokens")


def longest_prefix(table: DataFrame, budget: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, n_chars, n_tokens): the longest prefix of at most ``budget`` tokens and its exact count."""
    last = F.aggregate(F.transform("counts", lambda c, i: F.when(c <= budget, i)), F.lit(-1), lambda a, i: F.coalesce(i, a))
    fits = table.withColumn("_at", last).where("_at >= 0").select("doc_id", "text_hash", F.struct(
        (F.col("block") * block + F.col("_at")).alias("n_chars"), F.get("counts", F.col("_at")).cast("long").alias("n_tokens")).alias("_fit"))
    return fits.groupBy("doc_id", "text_hash").agg(F.max("_fit").alias("_fit")).select("doc_id", "text_hash", "_fit.*")
