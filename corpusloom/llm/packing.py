"""Mixture-controlled packing: deficit round-robin over source queues, with cuts at window ends.

Every source is a queue of tokens. A window of ``window`` tokens takes from each queue its share of the
mixture, which is the share of the queue in all tokens, so that all queues end together and no window
but the last is short. What a window owes a queue in fractions of a token is its deficit; it is carried
to the next window, whatever partition makes it. In integers: after w windows queue s has given

    floor(g * C(s) / T) - floor(g * C(s - 1) / T),   g = min(w * window, T)

tokens, with C the running totals of the queues and T the total. These add up to g exactly and never
fall behind a share by a token or more, and every task can compute them for any window, so windows that
span partitions need no exchange. Sources too small for four tokens a window share one queue.

A queue's order is the order of its documents in the tokenised table, which is written to the shared
folder once; its offsets are sums over (source, task), so no task sees all of a hot source.

Defined results: null and empty texts have only the end id; a null source is a source of its own; repeated
rows are packed as they come; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from corpusloom.llm._text import RecentTable, held, slices, stored

END_ID = 1
WINDOW = 2048
#: Rows of about 40 bytes.
MOST_BROADCAST = 250_000

# The pattern and the normaliser of the word tokenizer for which words may be encoded one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
#: ASCII and the Latin-1 letters: composed, and with lower-case forms of one character.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_CONTRACTION = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")
#: What str.split() takes for a blank and the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _kinds() -> np.ndarray:
    """0 blank, 1 letter, 2 digit, 3 other, for every lower-cased Latin-1 character of _PLAIN."""
    kinds = np.full(256, 3, np.uint8)
    kinds[[9, 10, 13, 32]] = 0
    kinds[97:123] = kinds[223:247] = kinds[248:256] = 1
    kinds[48:58] = 2
    return kinds


_KINDS = _kinds()


def split_words(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pre-tokens by WORD_PATTERN of plain texts, lower-cased and in Latin-1, in one list, and the place in it where each text begins."""
    raw = "\n".join(texts).lower().encode("latin-1")
    b = np.frombuffer(raw, np.uint8)
    kind = _KINDS[b]
    solid = kind != 0
    joint = solid[1:] & solid[:-1]  # between a character and the next
    joint &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    marks = np.flatnonzero(b[:-1] == 39)
    # An apostrophe that opens a run of other characters, before a letter.
    marks = marks[(kind[marks + 1] == 1) & ((marks == 0) | (kind[marks - 1] != 3))]
    for at in marks.tolist():
        if found := _CONTRACTION.match(raw, at):
            joint[at] = False
            if found.end() < len(raw) and solid[found.end()]:
                joint[found.end() - 1] = True
    words = np.insert(b, np.flatnonzero(joint) + 1, 32).tobytes().split()
    first = solid.copy()
    first[1:] &= ~solid[:-1] | joint
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(np.flatnonzero(first), offsets)


class WordEncoder:
    """Ids of a tokenizer, with words looked up in a bounded table.

    For the tokenizers whose pre-tokenizer is WORD_PATTERN every word is encoded by itself, so the ids of a plain text are
    those of its words in a row. No token and no normalisation reaches across a blank, so other texts are cut there;
    chunks that are not plain or hold the literal of an added token take the library's way. So do whole texts with an ASCII
    separator, and all texts of other tokenizers.
    """

    def __init__(self, definition: str, kind: str = "<u4", most_bytes: int = 64 << 20):
        self.tokenizer, self.kind = Tokenizer.from_str(definition), kind
        spec = json.loads(definition)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        self.added = [a["content"].lower() for a in spec.get("added_tokens") or [] if a.get("content")]
        self.by_word = (
            not any(re.search(r"\s", a) for a in self.added)
            and kinds == NORMALISERS
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and (pre[0]["pattern"].get("Regex"), pre[0]["behavior"], pre[0]["invert"]) == (WORD_PATTERN, "Removed", True)
            and not (pre[1]["add_prefix_space"] or pre[1]["use_regex"])
        )
        self.tokenize, self.code = self.tokenizer.model.tokenize, {"<u2": "H", "<u4": "I"}[kind]
        self.bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.odd = RecentTable(self._word, most_bytes), RecentTable(self._library, most_bytes // 8)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, word: bytes) -> bytes:
        """Ids of one pre-token, by the tokenizer's model alone."""
        text = word.decode("latin-1")
        if not text.isascii():
            text = self.bytewise.pre_tokenize_str(text)[0][0]
        ids = [t.id for t in self.tokenize(text)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _plain(self, text: str) -> bool:
        low = text.lower()
        return _PLAIN.fullmatch(text) is not None and not any(a in low for a in self.added)

    def _units(self, text: str | None) -> list[str]:
        """A text that is plain or must stay whole, or else its chunks between blanks."""
        if not text:
            return []
        if not self.by_word or self._plain(text) or any(c in text for c in _SEPARATORS):
            return [text]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, of the width that ``kind`` names."""
        units = [self._units(t) for t in texts]
        plain = [[self.by_word and self._plain(u) for u in us] for us in units]
        together = [u for us, ps in zip(units, plain, strict=True) for u, p in zip(us, ps, strict=True) if p]
        words, starts = split_words(together) if together else ([], np.zeros(1, np.int64))
        ids = map(self.words.turn().__getitem__, words)
        found = (b"".join(islice(ids, n)) for n in np.diff(starts).tolist())
        odd = self.odd.turn()
        return [b"".join([next(found) if p else odd[u] for u, p in zip(us, ps, strict=True)]) for us, ps in zip(units, plain, strict=True)]


@lru_cache(maxsize=2)
def _id_kind(definition: str, end_id: int) -> str:
    top = max(Tokenizer.from_str(definition).get_vocab().values(), default=0)
    return "<u2" if max(top, end_id) < 1 << 16 else "<u4"


def tokenised(docs: DataFrame, definition: str, end_id: int = END_ID, text: str = "text", source: str = "source", chunk: int = 512) -> DataFrame:
    """doc_id, source, task, local (tokens of that source before it in that task), n and ids of every row.

    Ids are little-endian, of 16 bits if the vocabulary allows and else of 32 (:func:`_id_kind`).
    """
    kind = _id_kind(definition, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = held(("words", definition), lambda: WordEncoder(definition, kind)), TaskContext.get().partitionId()
        end, width, sums = np.array([end_id], kind).tobytes(), int(kind[-1]), {}
        for b in slices(batches, chunk):
            ids = [x + end for x in encoder.encode(b.column("_text").to_pylist())]
            sizes = [len(x) // width for x in ids]
            local = []
            for s, n in zip(b.column("source").to_pylist(), sizes, strict=True):
                local.append(sums.get(s, 0))
                sums[s] = local[-1] + n
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array([task] * len(ids), pa.int32()), pa.array(local, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "source", "task", "local", "n", "ids"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("_text"))
    return chosen.mapInArrow(run, "doc_id bigint, source string, task int, local bigint, n bigint, ids binary")


class Mixture:
    """Where the tokens of each queue go: queue s has totals[s] tokens."""

    def __init__(self, totals: list[int], window: int):
        self.window, self.total = window, sum(totals)
        self.upto = [0]
        for t in totals:
            self.upto.append(self.upto[-1] + t)

    def _floor(self, s: int, w: int) -> int:
        return min(w * self.window, self.total) * self.upto[s] // self.total

    def given(self, s: int, w: int) -> int:
        """Tokens of queue s in the windows before w."""
        return self._floor(s + 1, w) - self._floor(s, w)

    def pieces(self, s: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before it in the run, length, window, offset there) of the ``n`` tokens of queue s from ``start`` on."""
        own = self.upto[s + 1] - self.upto[s]
        w = start * self.total // (self.window * own)
        while self.given(s, w) > start:
            w -= 1
        while self.given(s, w + 1) <= start:
            w += 1
        done = 0
        while done < n:
            first = self.given(s, w)
            size = min(n - done, self.given(s, w + 1) - start - done)
            if size > 0:
                yield done, size, w, self._floor(s, w + 1) - self._floor(s, w) + start + done - first
                done += size
            w += 1


def pack(docs: DataFrame, definition: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text", source: str = "source") -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (array<int>), ids_crc32, doc_tokens, sequence_id, offset.

    ``definition`` is the JSON of a tokenizer; every id of every row of ``docs`` lies in exactly one piece.
    """
    tokens = stored(tokenised(docs, definition, end_id, text, source), "tokens")
    by_task = tokens.groupBy("source", "task").agg(F.sum("n").alias("n"))
    by_source = by_task.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    n_bases = by_task.count()
    least = -(-4 * total // window)
    # At most window / 4 sources are that large.
    large = sorted(((r["source"], r["n"]) for r in by_source.where(F.col("n") >= max(1, least)).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    rest = total - sum(n for _, n in large)
    totals = [n for _, n in large]
    if rest >= least or not large:
        tail = len(large)
        totals.append(rest)
    else:  # too small for a queue: it follows the largest, whose bucket is -1
        tail = max(range(len(large)), key=lambda k: totals[k])
        totals[tail] += rest
    queue = F.lit(tail)
    for k, (s, _) in enumerate(large):
        queue = F.when(F.col("source").eqNullSafe(s), k).otherwise(queue)
    is_large = F.lit(False)
    for s, _ in large:
        is_large = is_large | F.col("source").eqNullSafe(s)
    placed = by_task.select("source", "task", "n", queue.alias("queue"), F.when(is_large, -1).otherwise(F.pmod(F.xxhash64("source"), F.lit(1024))).cast("int").alias("bucket"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("queue", "bucket").orderBy("source", "task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = placed.groupBy("queue", "bucket").agg(F.sum("n").alias("m"))
    lower = buckets.select("queue", "bucket", F.coalesce(F.sum("m").over(W.partitionBy("queue").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lower"))
    bases = placed.withColumn("within", before).join(lower, ["queue", "bucket"]).select(F.col("source").alias("_s"), F.col("task").alias("_t"), "queue", (F.col("within") + F.col("lower")).alias("base"))
    mixture, kind = Mixture(totals, window), _id_kind(definition, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        held("pieces")
        for part in slices(batches):
            b = part.to_pydict()
            rows: list[tuple] = []
            parts: list[bytes] = []
            for doc, src, n, raw, q, pos in zip(b["doc_id"], b["source"], b["n"], b["ids"], b["queue"], b["position"], strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
                for start, size, seq, off in mixture.pieces(q, pos, n):
                    parts.append(ids[4 * start : 4 * (start + size)])
                    rows.append((doc, src, start, size, zlib.crc32(parts[-1]), n, seq, off))
            doc, src, start, size, crc, n, seq, off = zip(*rows, strict=True) if rows else ((),) * 8
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<u4").astype(np.int32)))
            i64 = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, i64), pa.array(src, pa.string()), pa.array(start, i64), pa.array(size, i64), arrays, pa.array(crc, i64), pa.array(n, i64), pa.array(seq, i64), pa.array(off, i64)], names
            )

    # A row for each task and source: broadcast while their number, just counted, is small; else a shuffle.
    if n_bases <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    joined = tokens.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("task") == F.col("_t")))
    ready = joined.select("doc_id", "source", "n", "ids", "queue", (F.col("base") + F.col("local")).alias("position"))
    return ready.mapInArrow(cut, "doc_id bigint, source string, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
