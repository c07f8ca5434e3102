"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton on folded text.

Folding: NFKC, lower case, look-alike letters of other scripts and digits in place of letters are
mapped to one form, i and l (with 1) to one letter, zero-width characters vanish and anything else
that is no letter becomes a space. Terms of the lexicon are folded in the same way and match at the
start of a word. A match inside an exception phrase does not count. The sum of the weights is
normalised by length, and a logistic of both turns it into a score.

The lexicon and the logistic are learned from a bounded sample (``per_class`` documents of each label);
scoring reads whole texts. Defined results: a null or empty text has no match and the score of none;
ties score alike; overlapping terms that start at the same place count once, by the longest.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._models import sample_per_class
from corpusloom.llm._text import fresh, held, slices

# Look-alikes and the Latin letter that each stands for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɩ": "i", "ɑ": "a", "ո": "n", "օ": "o", "ս": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
GONE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

#: Least log-likelihood ratio of the document frequencies of a term.
LEAST_DOC_EVIDENCE = 12.0

#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "circus clown", "pathetic fallacy", "pond scum", "not an idiot", "not stupid")


class _Fold(dict):
    """Table for str.translate that learns other characters as they come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c if c.isalpha() or unicodedata.combining(c) else " "
        return out


def _table() -> _Fold:
    t = _Fold({ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()})
    t |= {ord(c): "" for c in GONE}
    t[ord("l")] = t[ord("ӏ")] = "i"
    return t


_FOLD = _table()


def fold(text: str | None) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class ToxicModel:
    """terms: folded word starts (with a space after for whole words) and their weights."""

    terms: tuple[tuple[str, float], ...]
    bias: float
    by_sum: float
    by_rate: float
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton | None:
        """Entries are (length, weight); exception phrases have the weight None."""
        entries = {f" {' '.join(fold(p).split())} ": None for p in self.exceptions}
        entries |= {f" {term}": weight for term, weight in self.terms}
        if not entries:
            return None
        a = ahocorasick.Automaton()
        for word, weight in entries.items():
            a.add_word(word, (len(word), weight))
        a.make_automaton()
        return a

    def score(self, measured: np.ndarray) -> np.ndarray:
        """Scores from rows of (sum of weights, words)."""
        z = self.bias + _inputs(measured) @ np.array([self.by_sum, self.by_rate])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def measure(automaton: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int]:
    """Sum of the weights of the matches that count, and the number of words."""
    words = fold(text).split()
    if not words or automaton is None:
        return 0.0, len(words)
    longest: dict[int, tuple[int, float]] = {}
    safe: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        start = end - size + 1
        if weight is None:
            safe.append((start, end))
        elif size > longest.get(start, (0, 0.0))[0]:
            longest[start] = (size, weight)
    total = sum(w for start, (size, w) in longest.items() if not any(a <= start and start + size - 1 <= b for a, b in safe))
    return float(total), len(words)


def _inputs(measured: np.ndarray) -> np.ndarray:
    """log(1 + sum) and log(1 + sum per hundred words)."""
    total, words = measured[:, 0], np.maximum(measured[:, 1], 1)
    return np.log1p(np.stack([total, 100 * total / words], 1))


def starts_of(text: str | None, shortest: int = 4, longest: int = 12) -> Counter[str]:
    """Occurrences of word starts of ``shortest`` to ``longest`` letters, and of whole words (with a space after)."""
    found: Counter[str] = Counter()
    for w, n in Counter(fold(text).split()).items():
        for k in range(shortest, min(len(w), longest) + 1):
            found[w[:k]] += n
        if len(w) <= longest:
            found[w + " "] += n
    return found


def evidence(bad: float, good: float, n_bad: float, n_good: float) -> float:
    """Log-likelihood ratio (G squared) of a term that is more frequent in the toxic words, else 0."""
    expect = (bad + good) / (n_bad + n_good)
    if not n_bad or bad / n_bad <= expect:
        return 0.0
    return float(2 * (bad * np.log(bad / (n_bad * expect)) + (good * np.log(good / (n_good * expect)) if good else 0.0)))


def learn_terms(bad: dict[str, float], good: dict[str, float], n_bad: float, n_good: float, least_evidence: float = 40.0, least_log_odds: float = 2.5, most_terms: int = 2000) -> tuple[tuple[str, float], ...]:
    """Terms that are far more frequent in toxic texts; the weight is the log of the frequency ratio.

    Of word starts that extend one another, the longest that keeps nine tenths of the occurrences of
    the shortest stands for all.
    """
    odds = {}
    for term, n in bad.items():
        ratio = float(np.log((n + 0.5) / (n_bad + 1)) - np.log((good.get(term, 0) + 0.5) / (n_good + 1)))
        if ratio >= least_log_odds and evidence(n, good.get(term, 0), n_bad, n_good) >= least_evidence:
            odds[term] = ratio
    longest_of: dict[str, str] = {}
    for term in sorted(odds, key=lambda t: (len(t), t)):
        root = next((term[:k] for k in range(4, len(term)) if term[:k] in longest_of), term)
        if root == term or bad[term] >= 0.9 * bad[root]:
            longest_of[root] = term
    best = sorted(longest_of.values(), key=lambda t: (-odds[t], t))[:most_terms]
    return tuple((t, odds[t]) for t in sorted(best))


def fit_logistic(measured: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> tuple[float, float, float]:
    """bias, by_sum and by_rate; both slopes stay at zero or above."""
    x, w, bias = _inputs(measured), np.zeros(2), -1.0
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + x @ w, -30, 30)))
        w = np.maximum(0, w - rate * (((p - y) * weight) @ x + decay * w))
        bias -= rate * float(((p - y) * weight).sum())
    return float(bias), float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicModel:
    """Fit on ``labels`` (doc_id, label 1 = toxic, 0 = not) and the texts of ``docs``; rows with a null label are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    everywhere = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = F.broadcast(sample_per_class(known, "label", per_class))  # at most per_class ids of two labels
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["label", "text"]).select("label", "text")  # copies count once

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences (three a document at most) and document frequencies in one task's share of the sample."""
        seen, docs_of = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
        held("toxicity")
        for b in slices(batches):
            for y, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                for term, n in starts_of(t).items():
                    seen[y][term] += min(n, 3)
                    docs_of[y][term] += 1
                seen[y][""] += len(fold(t).split())
        for y in (0, 1):
            keys = list(seen[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array([y] * len(keys), pa.int32()), pa.array(keys, pa.string()), pa.array([seen[y][k] for k in keys], pa.int64()), pa.array([docs_of[y][k] for k in keys], pa.int64())],
                ["label", "term", "n", "docs"],
            )

    classes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = classes.get(1, 0), classes.get(0, 0)
    toxic = F.col("label") == 1
    found = (
        rows.mapInArrow(terms, "label int, term string, n bigint, docs bigint")
        .groupBy("term")
        .agg(*(F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(k) for c, v, k in ((toxic, "n", "bad"), (~toxic, "n", "good"), (toxic, "docs", "bad_docs"), (~toxic, "docs", "good_docs"))))
        .where((F.col("term") == "") | ((F.col("bad_docs") >= 3) & (F.col("bad") >= 6) & (F.col("bad") * n_good >= 6 * F.col("good") * n_bad)))
        .collect()
    )
    got = {r["term"]: (r["bad"], r["good"]) for r in found if not r["term"] or evidence(r["bad_docs"], r["good_docs"], n_bad, n_good) >= LEAST_DOC_EVIDENCE}
    words_bad, words_good = got.pop("", (0, 0))
    lexicon = learn_terms({k: v[0] for k, v in got.items()}, {k: v[1] for k, v in got.items()}, words_bad, words_good)
    draft = ToxicModel(lexicon, 0.0, 0.0, 0.0, exceptions)
    measured = rows.mapInArrow(_measures(draft, ("label",)), "label int, _sum double, _words bigint").toPandas()
    if not len(measured):
        return ToxicModel((), -3.0, 1.0, 1.0, exceptions)
    y = measured["label"].to_numpy(np.float64)
    weight = np.where(y == 1, everywhere.get(1, 0) / max(1.0, y.sum()), everywhere.get(0, 0) / max(1.0, (1 - y).sum()))
    return ToxicModel(lexicon, *fit_logistic(measured[["_sum", "_words"]].to_numpy(np.float64), y, weight), exceptions)


def _measures(model: ToxicModel, keep: tuple[str, ...], text: str = "text", scored: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        automaton = model.automaton()
        for b in slices(batches):
            m = np.array([measure(automaton, t) for t in b.column(text).to_pylist()], np.float64).reshape(-1, 2)
            kept = [b.column(k) for k in keep]
            if scored:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(m[:, 0], pa.float64()), pa.array(model.score(m), pa.float64())], [*keep, "toxic_sum", "toxic_score"])
            else:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(m[:, 0], pa.float64()), pa.array(m[:, 1].astype(np.int64))], [*keep, "_sum", "_words"])

    return run


def score(docs: DataFrame, model: ToxicModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, toxic_sum (weights of the matches) and toxic_score (0 to 1) of every row."""
    own = fresh(docs, "_text")
    kept = docs.select(*keep, F.col(text).alias(own))
    schema = docs.select(*keep).schema.add("toxic_sum", "double").add("toxic_score", "double")
    return kept.mapInArrow(_measures(model, keep, own, scored=True), schema)
