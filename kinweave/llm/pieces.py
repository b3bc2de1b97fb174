"""SentencePiece encoding and decoding by one Viterbi pass over an Aho-Corasick automaton.

The automaton holds all normal pieces of a model file. Running it over a text gives at each position
every piece that ends there, by following the output links; each relaxes the best score of its end.
A character that no one-character piece covers costs the lowest score less 10 and is written as byte
pieces. Of equal scores the longer last piece stays. Scores are those of the model file.

Text is taken as it is: a space becomes the space mark, one mark is put in front, nothing else is
changed, and a space mark in the text itself is written as bytes. So decoding gives back every text.

No piece has a space mark after another character, and none has a line feed, so the best path always
has a cut before each run of spaces and around line feeds. Parts between such cuts are encoded on
their own and remembered (up to ``memory`` parts a worker). If a model breaks that rule, texts are
encoded whole.

A null text has null ids, an empty one has no ids. Rows stand as they are, whatever their doc_id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMORY = 200_000
_NORMAL, _USER, _BYTE = 1, 4, 6
_PART = re.compile(r" *[^ \n]+| +|\n+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def read_model(path: str = MODEL_PATH) -> tuple[tuple[str, float, int], ...]:
    """(piece, score, type) by id."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, _NORMAL)))
    return tuple(out)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def _shared(pieces: tuple[tuple[str, float, int], ...]) -> Tokenizer:
    """One tokenizer a worker process, with what it remembers."""
    return Tokenizer(pieces)


class Tokenizer:
    """Built on each worker from the pieces that the driver read."""

    def __init__(self, pieces: tuple[tuple[str, float, int], ...], memory: int = MEMORY):
        self.machine = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.raw: list[bytes] = [b""] * len(pieces)
        self.byte = [0] * 256
        lowest, self.cuts = 0.0, True
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == _BYTE:
                value = int(piece[3:5], 16)
                self.raw[i], self.byte[value] = bytes([value]), i
            elif kind in (_NORMAL, _USER):
                self.raw[i] = piece.replace(MARK, " ").encode()
                self.machine.add_word(piece, (i, len(piece), score))
                lowest = min(lowest, score)
                if len(piece) == 1:
                    self.single.add(piece)
                self.cuts &= "\n" not in piece and MARK not in piece.lstrip(MARK)
        self.machine.make_automaton()
        self.unknown = lowest - 10
        self.known: dict[str, bytes] = {}
        self.memory = memory

    def best(self, text: str) -> tuple[list[int], float]:
        """(ids, score) of the best path through a marked text."""
        n = len(text)
        score = [float("-inf")] * (n + 1)
        last: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # (size, id), id -1: bytes
        score[0] = 0.0
        if self.single.issuperset(text):
            for end, (piece, size, value) in self.machine.iter(text):
                end += 1
                value += score[end - size]
                if value > score[end]:
                    score[end], last[end] = value, (size, piece)
        else:
            self._with_unknown(text, score, last)
        out, i = [], n
        while i > 0:
            size, piece = last[i]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte[b] for b in reversed(text[i - 1].encode())]
            i -= size
        out.reverse()
        return out, score[n]

    def _with_unknown(self, text: str, score: list[float], last: list[tuple[int, int]]) -> None:
        """The same where some characters stand for no piece: they go as bytes, each for one step."""
        done = 0

        def settle(upto: int) -> None:
            nonlocal done
            for i in range(done, upto):
                if text[i] not in self.single and score[i] + self.unknown > score[i + 1]:
                    score[i + 1], last[i + 1] = score[i] + self.unknown, (1, -1)
            done = max(done, upto)

        for end, (piece, size, value) in self.machine.iter(text):
            settle(end)
            value += score[end + 1 - size]
            if value > score[end + 1]:
                score[end + 1], last[end + 1] = value, (size, piece)
        settle(len(text))

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = _packed(self.best(part.replace(" ", MARK))[0])
            if len(self.known) >= self.memory:
                self.known.clear()
            if len(part) < 64:
                self.known[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        out = []
        for i, piece in enumerate((" " + text).split(MARK)):
            if i:
                out.append(_packed([self.byte[b] for b in MARK.encode()]))
            parts = _PART.findall(piece) if self.cuts else [piece]
            out += map(self._part, parts)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode()


def _each(pieces, work: Callable[[Tokenizer, list], pa.RecordBatch]):
    def run(batches):
        tokenizer = _shared(pieces)
        for batch in batches:
            yield work(tokenizer, batch)

    return run


def encode(table: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit), n_tokens of every row."""

    def work(tokenizer, batch):
        ids = [None if t is None else tokenizer.encode(t) for t in batch.column(1).to_pylist()]
        count = [None if x is None else len(x) // 4 for x in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(count, pa.int64())], ["doc_id", "ids", "n_tokens"])

    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_each(read_model(path), work), "doc_id long, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids, n_tokens and the text of every row of encode()."""

    def work(tokenizer, batch):
        text = [None if x is None else tokenizer.decode(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(_each(read_model(path), work), "doc_id long, ids binary, n_tokens long, text string")


def unpack(ids: str = "ids"):
    """The packed ids as an array of ints."""
    word = F.expr(f"transform(sequence(0, greatest(length({ids}) div 4, 1) - 1), i -> conv(hex(reverse(substring({ids}, i * 4 + 1, 4))), 16, 10))")
    return F.when(F.length(ids) == 0, F.array().cast("array<int>")).otherwise(word.cast("array<int>"))
