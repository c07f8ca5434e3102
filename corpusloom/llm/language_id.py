"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier on hashed letter n-grams predicts each bit. The
decoder adds up the logistic loss of every bit against each codeword, weighted by how well that bit
did in training, and takes the codeword with the least loss. A second-best codeword that is nearly as
near makes the answer ambiguous.

The fit uses a bounded sample (``per_class`` documents of each language), whose counts are sent to the driver
compressed, and makes their vectors there once; prediction reads whole texts.
Defined results: ``und`` with score 0 for a null text or one without a letter; equal losses go to the
language that sorts first; a corpus with one language has one codeword and score 1.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._models import sample_per_class
from corpusloom.llm._text import fresh, held, slices

DIM = 1 << 12
UNDETERMINED = "und"

_FOLD = bytes(ord(chr(i).lower()) if chr(i).isalpha() and i < 128 else (i if i >= 128 else 32) for i in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def gram_counts(text: str, dim: int = DIM) -> np.ndarray:
    """Counts of hashed byte bi-, tri- and four-grams over letters."""
    b = np.frombuffer(b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(dim, np.int64)
    h = b
    for n in (2, 3, 4):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :] * np.uint32(0x9E3779B1)
        total += np.bincount((h >> np.uint32(7)) & np.uint32(dim - 1), minlength=dim)
    return total


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, at unit length."""
    root = np.sqrt(counts)
    norm = np.linalg.norm(root)
    return root / norm if norm else root


def gram_vector(text: str, dim: int = DIM) -> np.ndarray:
    return unit(gram_counts(text, dim))


def codewords(classes: int) -> np.ndarray:
    """One row of +1 and -1 per class; all columns differ and none is constant.

    Up to six classes: every split of the classes into two groups (2**(classes-1) - 1 bits).
    More: ``8 * ceil(log2(classes))`` columns from a seeded generator, drawn until rows lie far apart.
    """
    if classes == 1:
        return np.ones((1, 1))
    if classes <= 6:
        columns = [[1 if c == 0 or not (k >> (c - 1)) & 1 else -1 for c in range(classes)] for k in range(1, 1 << (classes - 1))]
        return np.array(columns, np.float64).T
    rng, bits = np.random.default_rng(42), 8 * int(np.ceil(np.log2(classes)))
    best, gap = None, -1
    for _ in range(200):
        m = rng.choice((-1.0, 1.0), (classes, bits))
        apart = ((bits - m @ m.T) / 2 + bits * np.eye(classes)).min()  # least Hamming distance of two rows
        if apart > gap and not (np.abs(m.sum(0)) == classes).any():
            best, gap = m, apart
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each row of n-gram vectors against each codeword."""
        margin = x @ self.weights + self.bias
        per_bit = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :])
        return (per_bit * self.trust).sum(2)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of exp(-loss), and the gap in share to the next."""
        loss = self.losses(x)
        p = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(p, 1)
        return best, p[np.arange(len(p)), best], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def fit_codes(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], rounds: int = 120, rate: float = 20.0, decay: float = 1e-5) -> LanguageModel:
    """One logistic classifier per bit (classes weigh alike), then the trust in each bit from its training error."""
    code = codewords(len(languages))
    target = code[y]
    share = 1.0 / np.bincount(y, minlength=len(languages))[y] / len(np.unique(y))
    w, bias = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    x = x.astype(np.float32, copy=False)
    for _ in range(rounds):
        pull = target / (1 + np.exp(np.clip(target * (x @ w.astype(np.float32) + bias), -30, 30))) * share[:, None]
        w += rate * (x.T @ pull.astype(np.float32) - decay * w)
        bias += rate * 0.1 * pull.sum(0)
    wrong = ((np.sign(x @ w.astype(np.float32) + bias) != target) * share[:, None]).sum(0)
    trust = np.log((1 - np.clip(wrong, 0.01, 0.49)) / np.clip(wrong, 0.01, 0.49))
    return LanguageModel(languages, code, w, bias, trust / trust.mean(), 1.0)


def fit(docs: DataFrame, per_class: int = 500) -> LanguageModel | None:
    """Fit on the rows of ``docs`` (doc_id, text, lang) with a text and a lang; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = sample_per_class(known.select("doc_id", "lang"), "lang", per_class)
    rows = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("lang", "text")  # at most per_class ids a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language")
        for b in slices(batches):
            x = [zlib.compress(gram_counts(t).tobytes(), 1) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

    got = rows.mapInArrow(run, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    lang, sent = got.column("lang").to_pylist(), got.column("x").to_pylist()
    del got

    def vector(k: int) -> np.ndarray:
        return unit(np.frombuffer(zlib.decompress(sent[k]), np.int64)).astype(np.float32)

    # The order of rows must not show in the sums.
    order = sorted(range(len(lang)), key=lambda k: (lang[k], hashlib.blake2b(vector(k), digest_size=16).digest()))
    languages = tuple(sorted(set(lang)))
    x = np.empty((len(order), DIM), np.float32)
    for row, k in zip(x, order, strict=True):
        row[:] = vector(k)
    return fit_codes(x, np.array([languages.index(lang[k]) for k in order]), languages)


def predict(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ambiguous_below: float = 0.1, chunk: int = 256, suffix: str = "") -> DataFrame:
    """``keep``, lang_pred, lang_score and lang_ambiguous (with ``suffix``) of every row."""
    own = fresh(docs, "_text")
    kept = docs.select(*keep, F.col(text).alias(own))
    names = [f"{n}{suffix}" for n in ("lang_pred", "lang_score", "lang_ambiguous")]
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language")
        for b in slices(batches, chunk):
            texts = b.column(own).to_pylist()
            lang, score, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            rows = [i for i, t in enumerate(texts) if model and has_letter(t)]
            if rows:
                best, p, gap = model.decode(np.array([gram_vector(texts[i]) for i in rows]))
                for i, k, s, g in zip(rows, best, p, gap, strict=True):
                    lang[i], score[i], unsure[i] = model.languages[k], float(s), bool(g < ambiguous_below)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                [*b.schema.names[:-1], *names],
            )

    return kept.mapInArrow(run, schema)
