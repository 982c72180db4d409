"""Operator 6, SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary drives a single-pass Viterbi: at every position the
automaton's output links give all pieces that end there, and each relaxes the best score up to that
position. The best segmentation has the largest sum of piece scores; ties go to fewer pieces, then
to the longer last piece. A character that no piece covers costs less than any piece
(``UNKNOWN_PENALTY`` below the lowest score) and becomes its UTF-8 byte pieces.

White space is written as U+2581 with one in front of the text, as the model does; a U+2581 in the
text is read as a space. No piece joins a U+2581 to what stands before it and none holds a line
feed, so the text falls into chunks whose segmentations are independent; a task remembers the chunks
it has met, up to a fixed number.

Null and empty texts have no ids. Decoding the ids gives the text back. Repeated rows are encoded each; very long texts go
chunk by chunk; empty tables give empty results. Columns beyond doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

MARK = "▁"
UNKNOWN_PENALTY = 10.0
UNSCORED = -1e8
REMEMBERED = 600_000
LONGEST_REMEMBERED = 64
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

_MODELS: dict = {}


class Pieces:
    """The vocabulary of a SentencePiece model file, its automaton, and the chunks met so far."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.text = {}, {}
        automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.check(piece)
                self.text[i] = piece
        scores = {i: model.get_score(i) for i in self.text}
        usual = [v for v in scores.values() if v > UNSCORED] or [0.0]
        # pieces added without a score (runs of spaces) are as good as the best piece for each character
        self.scores = {i: v if v > UNSCORED else len(self.text[i]) * max(usual) - 0.1 for i, v in scores.items()}
        for i, piece in self.text.items():
            automaton.add_word(piece, (len(piece), self.scores[i], i))
        automaton.make_automaton()
        self.automaton, self.unknown = automaton, min(usual) - UNKNOWN_PENALTY
        self.values = {i: bytes([b]) for b, i in self.bytes.items()} | {i: p.encode() for i, p in self.text.items()}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def check(piece: str) -> None:
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses a chunk border")

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best segmentation of a chunk."""
        n = len(chunk)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-1e18, 0)] * n  # score, minus the number of pieces
        back = [(0, -1)] * (n + 1)
        matches: dict[int, list] = {}
        for end, piece in self.automaton.iter(chunk):
            matches.setdefault(end + 1, []).append(piece)
        for end in range(1, n + 1):
            score, few = best[end - 1]
            top, link = (score + self.unknown, few - 1), (end - 1, -1)
            for length, value, i in matches.get(end, ()):  # longest first
                score, few = best[end - length]
                if (score + value, few - 1) > top or link[1] < 0 and (score + value, few - 1) == top:
                    top, link = (score + value, few - 1), (end - length, i)
            best[end], back[end] = top, link
        ids: list[int] = []
        while n:
            start, i = back[n]
            ids += [i] if i >= 0 else [self.bytes[b] for b in reversed(chunk[start:n].encode())]
            n = start
        return ids[::-1]

    def chunk(self, chunk: str) -> bytes:
        got = self.known.get(chunk)
        if got is None:
            ids = self.viterbi(chunk)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.known) < REMEMBERED and len(chunk) <= LONGEST_REMEMBERED:
                self.known[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.chunk, CHUNK.findall(MARK + text.replace(" ", MARK))))

    def decode(self, ids: bytes) -> str:
        """The text of ids that ``encode`` made."""
        raw = b"".join(map(self.values.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ids): the whole texts (null: empty) and their ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # ids are about as long as the texts
                part = batch.slice(at, 256)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = pa.array([own.decode(x) for x in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
