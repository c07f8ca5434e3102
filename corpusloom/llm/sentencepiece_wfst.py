"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three machines of states and arcs: a normaliser (blank to the space mark, the dummy
prefix, and blank removal if the model asks for it), a lexicon whose paths spell pieces and whose final states emit
their ids with a weight, and the byte fallback, a path of byte ids for a character that no piece has. An input is composed
with the normaliser and the result with the lexicon and the fallback, state by state as it is reached; the states of the
composition are (place in the input, last piece), and its tropical shortest path is the encoding.

Weights. In a unigram model a piece weighs its negated score. A BPE model does not prefer the best sum: its result is
the one sequence in which every two neighbours are stable, that is, in which merging their characters by score gives
the two back. The composition therefore has a bigram acceptor that gives unstable neighbours infinite weight; all pieces
weigh one, and a single path of finite weight is left, the merge result. Which of the two applies is read from the
model.

Text is composed run by run: no piece crosses from another character into a space mark, nor into a character that no
piece has, so runs end there, and the paths of frequent runs are kept in a bounded table. Models with a character map
are not compiled. Defined results: null and empty texts have no ids; rows are encoded one by one, so repeated rows get
equal ids; of paths of equal weight the one whose last piece is longest is taken; decoding ids gives the text back, but
for literal space marks (they become blanks) and lone surrogates; unknown ids are an error.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusloom.llm._text import RecentTable, fresh, held, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = data[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """The parts of a model file that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.algorithm, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.remove_extra, self.escape, charsmap, suffix = True, True, True, b"", False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.algorithm, self.byte_fallback, suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.remove_extra, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if charsmap or suffix or self.algorithm not in (UNIGRAM, BPE):
            raise ValueError("character maps, space suffixes and models other than unigram and BPE are not compiled")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


#: States of the normaliser: before any text, after a character, and after blanks that may be dropped.
START, WITHIN, BLANKS = 0, 1, 2


def normaliser(m: Model) -> dict[tuple[int, bool], tuple[int, str, bool]]:
    """Arcs by (state, whether the character is a blank): next state, what is put out first, and whether the character follows."""
    mark = MARK if m.escape else " "
    prefix = mark if m.dummy_prefix else ""
    if m.remove_extra:
        return {
            (START, True): (START, "", False),
            (START, False): (WITHIN, prefix, True),
            (WITHIN, True): (BLANKS, "", False),
            (WITHIN, False): (WITHIN, "", True),
            (BLANKS, True): (BLANKS, "", False),
            (BLANKS, False): (WITHIN, mark, True),
        }
    return {
        (START, True): (WITHIN, prefix + mark, False),
        (START, False): (WITHIN, prefix, True),
        (WITHIN, True): (WITHIN, mark, False),
        (WITHIN, False): (WITHIN, "", True),
    }


class Lexicon:
    """Arcs from state to state by characters; a final state has the id and the weight of the piece spelled on the way."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.ids: list[int] = [-1]
        self.weights: list[float] = [INFINITE]

    def add(self, piece: str, number: int, weight: float) -> None:
        state = 0
        for c in piece:
            state = self.arcs[state].setdefault(c, len(self.arcs))
            if state == len(self.arcs):
                self.arcs.append({})
                self.ids.append(-1)
                self.weights.append(INFINITE)
        self.ids[state], self.weights[state] = number, weight


class Transducer:
    """The compiled machines of one model, and what has been composed with them so far."""

    def __init__(self, data: bytes, most_bytes: int = 96 << 20, most_pairs: int = 600_000):
        self.model = m = Model(data)
        self.bpe = m.algorithm == BPE
        spelled = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k in (NORMAL, USER)}
        self.score = {p: m.scores[i] for p, i in spelled.items()}
        self.normaliser, self.lexicon = normaliser(m), Lexicon()
        for p, i in spelled.items():
            # In a merge model a piece that its own merges do not give is on no path.
            if not self.bpe or len(p) == 1 or self.merged(p) == [p]:
                self.lexicon.add(p, i, 1.0 if self.bpe else -self.score[p])
        self.known = {c for p in spelled for c in p}
        self.decoded = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        cut = "".join(re.escape(c) for c in "\t\n\r" if c not in self.known)
        # With pieces that hold a mark further in, or blanks that stay as they are, an input is one run.
        whole = not m.escape or any(MARK in p.lstrip(MARK) for p in spelled)
        self.run = re.compile("(?s:.+)" if whole else f"[ {MARK}]*(?:[^ {MARK}{cut}]+{f'|[{cut}]' if cut else ''})|[ {MARK}]+")
        self.first, self.later = (RecentTable(lambda run, at=state: self.composed(run, at), size) for state, size in ((START, most_bytes // 8), (WITHIN, most_bytes)))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most_pairs = most_pairs

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged by score, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -INFINITE, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """The bigram acceptor: whether the two pieces stay as they are."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            a, b = self.model.pieces[left], self.model.pieces[right]
            found = self.pairs[key] = self.merged(a + b) == [a, b]
        return found

    def fallback(self, c: str) -> list[int]:
        """Ids on the path of a character without a piece: its bytes, or the unknown id."""
        m = self.model
        if m.byte_fallback and m.bytes_at:
            return [m.bytes_at[x] for x in c.encode("utf-8", "replace")]
        return [m.unknown]

    def normalise(self, text: str, state: int = START) -> str:
        """What the normaliser puts out for a text, from a state on."""
        out = []
        for c in text:
            state, before, follows = self.normaliser[state, c == " "]
            out.append(before + c if follows else before)
        return "".join(out)

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the path of least weight through the composition of a normalised run with the lexicon and the fallback."""
        n, bpe, pairs, known = len(text), self.bpe, self.pairs, self.known
        arcs, ids, weights = self.lexicon.arcs, self.lexicon.ids, self.lexicon.weights
        weight: list[float] = [0.0] + [INFINITE] * n
        last = [-1] * (n + 1)  # the piece that ends at each place on its best path; -1 at the start and after a fallback
        back = [0] * (n + 1)
        for start in range(n):
            so_far = weight[start]
            if so_far == INFINITE:
                continue
            before, state = last[start], 0
            for end in range(start, n):
                state = arcs[state].get(text[end])
                if state is None:
                    break
                piece = ids[state]
                # A merge model has no second path of finite weight.
                if piece < 0 or so_far + weights[state] >= weight[end + 1] or (bpe and weight[end + 1] < INFINITE):
                    continue
                if bpe and before >= 0:
                    fits = pairs.get((before, piece))
                    if not (self.stable(before, piece) if fits is None else fits):
                        continue
                weight[end + 1], back[end + 1], last[end + 1] = so_far + weights[state], start, piece
            if text[start] not in known and so_far + 100.0 < weight[start + 1]:
                weight[start + 1], back[start + 1], last[start + 1] = so_far + 100.0, start, -1
        out: list[list[int]] = []
        end = n
        while end:
            out.append([last[end]] if last[end] >= 0 else self.fallback(text[end - 1]))
            end = back[end]
        return [i for part in reversed(out) for i in part]

    def composed(self, run: str, state: int) -> bytes:
        """Ids of one run of raw text, little-endian and of 32 bits, from a state of the normaliser on."""
        ids = self.shortest_path(self.normalise(run, state))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        if self.model.remove_extra:
            text = text.lstrip(" ")
        runs = self.run.findall(text)
        if not runs:
            return b""
        first = self.first.turn()[runs[0]]
        return first + b"".join(map(self.later.turn().__getitem__, runs[1:]))

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids."""
        text = b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = 128, ids: bool = True, digest: bool = False) -> DataFrame:
    """``keep`` and, of every row: ids (array<int>) if asked for; with ``digest`` n_ids, ids_crc32 (of little-endian
    32-bit ids) and round_trip (whether decoding the ids gives the text; null for a null text)."""
    own = fresh(docs, "_text")
    kept = docs.select(*keep, F.col(text).alias(own))
    schema = docs.select(*keep).schema
    if ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    if digest:
        schema = schema.add("n_ids", "long").add("ids_crc32", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = held(("machines", zlib.crc32(model), len(model)), lambda: Transducer(model))
        for b in slices(batches, chunk):
            texts = b.column(own).to_pylist()
            found = [fst.encode(t) for t in texts]
            columns = list(b.columns[:-1])
            if ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))))
            if digest:
                columns.append(pa.array([len(x) // 4 for x in found], pa.int64()))
                columns.append(pa.array([zlib.crc32(x) for x in found], pa.int64()))
                columns.append(pa.array([None if t is None else fst.decode(x) == t for t, x in zip(texts, found, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), chunk: int = 128) -> DataFrame:
    """``keep`` and text of every row of ``encoded``; null ids give a null text."""
    own = fresh(encoded, "_ids")
    kept = encoded.select(*keep, F.col(ids).alias(own))
    schema = encoded.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = held(("machines", zlib.crc32(model), len(model)), lambda: Transducer(model))
        for b in slices(batches, chunk):
            texts = [None if x is None else fst.decode(np.array(x, "<u4").tobytes()) for x in b.column(own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], schema.fieldNames())

    return kept.mapInArrow(run, schema)
