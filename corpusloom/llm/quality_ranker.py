"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A labelled good document is preferred to a labelled bad one. The weights minimise the mean logistic loss on
the feature differences of all such pairs; the cut is the quantile of the training scores that leaves the
bad share of the labelled documents below it. The reported score is a logistic of the distance from
that cut, so 0.5 is the cut itself.

The fit uses every labelled document and every pair of a good and a bad one; scoring reads every whole text.
Pairs are never rows: a pair's loss depends on two scores only, so each class is added up in narrow bins of the
score (with the first two moments in a bin; a pair's slope is off by less than 1e-7) and the bins are paired.
The driver gets the bins, whose number doesn't depend on that of the documents.
Defined results: a null or empty text has all-zero features and is scored like any other; ties score
alike; a repeated row of ``labels`` counts once, a repeated row of ``docs`` as often as it is there, one with
both labels on both sides; extra columns of the input pass through only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from corpusloom.llm._text import fresh, held, slices, stored

FEATURES = (
    "log_words", "few_words", "word_chars", "short_words", "long_words", "upper_letters", "marks", "exclamations",
    "bars", "symbols", "digits", "other_ascii", "wide", "distinct_words", "next_word_repeats", "top_word", "dup_lines", "line_words",
)

#: Labelled ids (60 to 90 bytes each) that are broadcast to the texts; more are joined to features, which are shuffled for it.
MOST_BROADCAST = 250_000

#: Width of the bins of scores.
_STEP = 1 / 64

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#$%&*<>@^~=+_\\", "mark": b".,;:?'\"()-"}


def features(text: str | None) -> list[float]:
    """Length, letter-case, symbol and repetition ratios of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = {k: int(counts[np.frombuffer(v, np.uint8)].sum()) for k, v in _KINDS.items()}
    bang, bar = int(counts[33]), int(counts[124])
    wide = int(counts[128:].sum())
    chars = sum(map(len, words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    letters = of["upper"] + of["lower"] + wide
    other = chars - letters - of["digit"] - of["symbol"] - of["mark"] - bang - bar
    return [
        np.log1p(n), float(n < 5), chars / n, float((lengths <= 1).mean()), float((lengths > 20).mean()), of["upper"] / max(1, letters),
        of["mark"] / n, bang / n, bar / n, of["symbol"] / n, of["digit"] / chars, other / chars, wide / chars,
        len(ids) / n * min(1.0, np.sqrt(n / 1000) + 0.3), float((number[1:] == number[:-1]).mean()) if n > 1 else 0.0,
        float(np.bincount(number).max()) / n if n >= 20 else 0.05, (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
    ]


def feature_matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class QualityModel:
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    spread: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - np.array(self.centre)) / np.array(self.scale), -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Added up row by row: a matrix product may round a row differently beside other rows.
        return (self.scaled(x) * np.array(self.weights)).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.spread, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Fit on ``labels`` (doc_id, label 1 = good, 0 = bad) and the texts of ``docs``; rows with a null label are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    few = known.count() <= MOST_BROADCAST
    known = known.dropDuplicates(["doc_id", "label"])
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    if few:
        rows = _featured(texts.join(F.broadcast(known), "doc_id"), "label")
    else:
        rows = _featured(texts, "doc_id").join(known, "doc_id").select("label", "x")
    return fit_pairs(stored(rows, "quality-features"))


def _featured(rows: DataFrame, keep: str) -> DataFrame:
    """``keep`` and the features x of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for b in slices(batches):
            x = feature_matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(list(x), pa.list_(pa.float64()))], [keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, rows.select(keep).schema.add("x", ArrayType(DoubleType())))


def fit_pairs(rows: DataFrame, decay: float = 1e-3) -> QualityModel:
    """Bradley-Terry weights from all pairs of a good and a bad row of ``rows`` (label, x), and the cut at the bad share's quantile.

    Newton's method: a pass over the rows adds up the bins of the scores, another the gradient and the curvature.
    """
    d = len(FEATURES)
    of = [f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(d)]
    n_bad, n_good, *moments = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), *of).first()
    if not n_good or not n_bad:
        return QualityModel((0.0,) * d, (1.0,) * d, (0.0,) * d, 0.0 if n_bad else -1.0, 1.0)
    model = QualityModel(tuple(moments[:d]), tuple(m + 1e-6 for m in moments[d:]), (0.0,) * d, 0.0, 1.0)

    def at(w: np.ndarray) -> tuple[float, _Bins]:
        bins = _Bins.of(rows, replace(model, weights=tuple(w.tolist())), (n_bad, n_good))
        return bins.loss() + decay / 2 * float(w @ w), bins

    w = np.zeros(d)
    loss, bins = at(w)
    # Weights beyond this radius lose more by the decay than weights of zero do in all.
    radius = float(np.sqrt(2 * loss / decay))
    for _ in range(200):
        slope, curve = bins.derivatives(rows)
        slope += decay * w
        step = np.linalg.solve(curve + decay * np.eye(d), slope)
        gain = float(slope @ step)
        if gain < 1e-9:
            break
        t = 1.0
        while np.linalg.norm(w - t * step) > radius:
            t /= 2
        then, new = at(w - t * step)
        while then > loss - 0.1 * t * gain and t * gain > 1e-6:
            t /= 2
            then, new = at(w - t * step)
        w, loss, bins = w - t * step, then, new
    else:
        raise ArithmeticError("the weights of the pairwise ranking don't settle")
    model = replace(model, weights=tuple((w - step).tolist()))
    both = (0, 1)
    wanted = [(both, n_bad - 1), (both, n_bad), ((1,), (n_good - 1) // 2), ((1,), n_good // 2), ((0,), (n_bad - 1) // 2), ((0,), n_bad // 2)]
    s = scores_at(rows, model, wanted)
    return replace(model, cut=(s[0] + s[1]) / 2, spread=max(1e-3, 0.25 * ((s[2] + s[3]) / 2 - (s[4] + s[5]) / 2)))


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("label").to_numpy(), b.column("x").flatten().to_numpy().reshape(b.num_rows, len(FEATURES))


def _signed(b: pa.RecordBatch, model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label, features and bin of every row, and the score's distance from the bin's centre.

    Features and score of a good row have their signs changed, so that a pair's loss is a function of the sum of its two scores.
    """
    label, x = _columns(b)
    z = model.scaled(x)
    u = np.where((label == 1)[:, None], -z, z)
    v = (u * np.array(model.weights)).sum(1)
    cell = np.rint(v / _STEP).astype(np.int64)
    return label, u, cell, v - cell * _STEP


def _met(kernel: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For every i the sum over j of sums[j] * kernel[i + j], by Fourier transforms."""
    n = 1 << (len(kernel) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(kernel, n) * np.conj(np.fft.rfft(sums, n)), n)[: len(kernel) - len(sums) + 1]


@dataclass(frozen=True)
class _Bins:
    """Of each class (bad, good): first bin, and for every bin the means of count, distance, squared distance and features."""

    model: QualityModel
    counts: tuple[int, int]
    first: tuple[int, int]
    sums: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, rows: DataFrame, model: QualityModel, counts: tuple[int, int]) -> _Bins:
        names = [f"s{i}" for i in range(3 + len(FEATURES))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                label, u, cell, off = _signed(b, model)
                keys, of = np.unique(cell * 2 + label, return_inverse=True)
                sums = [np.bincount(of, c, len(keys)) for c in (np.ones(len(of)), off, off * off, *u.T)]
                yield pa.RecordBatch.from_arrays([pa.array(keys & 1), pa.array(keys >> 1), *map(pa.array, sums)], ["label", "cell", *names])

        parts = rows.mapInArrow(run, "label long, cell long, " + ", ".join(f"{c} double" for c in names))
        got = parts.groupBy("label", "cell").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        label, cell = got["label"].to_numpy(), got["cell"].to_numpy()
        table = np.stack([got[c].to_numpy() for c in names], 1)
        first, sums = [], []
        for c in (0, 1):
            own = cell[label == c]
            first.append(int(own.min()))
            sums.append(np.zeros((int(own.max()) - first[c] + 1, len(names))))
            sums[c][own - first[c]] = table[label == c] / counts[c]
        return cls(model, counts, tuple(first), tuple(sums))

    def kernels(self) -> tuple[np.ndarray, ...]:
        """Loss of a pair and its first three derivatives, at all sums of two bins."""
        x = (sum(self.first) + np.arange(len(self.sums[0]) + len(self.sums[1]) - 1)) * _STEP
        p = np.exp(-np.logaddexp(0, -x))
        return np.logaddexp(0, x), p, p * (1 - p), p * (1 - p) * (1 - 2 * p)

    def loss(self) -> float:
        k0, k1, k2, _ = self.kernels()
        own, (n, off, square) = self.sums[1], self.sums[0][:, :3].T
        value, slope = _met(k0, n) + _met(k1, off) + _met(k2, square) / 2, _met(k1, n) + _met(k2, off)
        return float(own[:, 0] @ value + own[:, 1] @ slope + own[:, 2] @ _met(k2, n) / 2)

    def derivatives(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the mean loss. The curvature takes scores for their bins' centres, so it is that of real pairs: never negative."""
        _, k1, k2, k3 = self.kernels()
        tables = []
        for other in (1, 0):
            n, off, square = self.sums[other][:, :3].T
            tables.append((_met(k1, n) + _met(k2, off) + _met(k3, square) / 2, _met(k2, n) + _met(k3, off), _met(k3, n) / 2, _met(k2, n)))
        model, counts, first, d = self.model, self.counts, self.first, len(FEATURES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slope, curve = np.zeros(d), np.zeros((d, d))
            for b in batches:
                label, u, cell, off = _signed(b, model)
                for c in (0, 1):
                    own = label == c
                    value, change, bend, weight = (t[cell[own] - first[c]] for t in tables[c])
                    slope += (value + change * off[own] + bend * off[own] ** 2) @ u[own] / counts[c]
                    curve += (u[own] * weight[:, None]).T @ u[own] / counts[c]
            yield pa.RecordBatch.from_arrays([pa.array([slope]), pa.array([curve.ravel()])], ["slope", "curve"])

        got = rows.mapInArrow(run, "slope array<double>, curve array<double>").collect()
        slope, curve = (np.sum([r[c] for r in got], 0) for c in ("slope", "curve"))
        cross = self.sums[1][:, 3:].T @ np.stack([_met(k2, c) for c in self.sums[0][:, 3:].T], 1)
        return slope, curve.reshape(d, d) + cross + cross.T


def _ordered(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles whose bits they are; its own inverse."""
    return np.where(a >= 0, a, a ^ np.int64((1 << 63) - 1))


def scores_at(rows: DataFrame, model: QualityModel, wanted: list[tuple[tuple[int, ...], int]]) -> list[float]:
    """The exact raw scores at places (from 0) among the rows of some labels, in rising order.

    Scores are counted by the leading 12 bits, then those that share them by the next 12, and so on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, x = _columns(b)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(_ordered((model.raw(x) + 0.0).view(np.int64)))], ["label", "key"])

    keys = rows.mapInArrow(run, "label int, key long")
    found, last = [(place, 0) for _, place in wanted], 64
    for shift in (52, 40, 28, 16, 4, 0):
        own = keys if last == 64 else keys.where(F.shiftright("key", last).isin(sorted({p for _, p in found})))
        got = own.groupBy("label", F.shiftright("key", shift).alias("part")).agg(F.count("*").alias("n")).toArrow()
        label, part, n = (got[c].to_numpy() for c in ("label", "part", "n"))
        for i, (labels, _) in enumerate(wanted):
            place, before = found[i]
            use = np.isin(label, labels) & ((part >> (last - shift) == before) if last < 64 else True)
            parts, of = np.unique(part[use], return_inverse=True)
            upto = np.bincount(of, n[use]).astype(np.int64).cumsum()
            k = int(np.searchsorted(upto, place, side="right"))
            found[i] = (place - (int(upto[k - 1]) if k else 0), int(parts[k]))
        last = shift
    return _ordered(np.array([p for _, p in found], np.int64)).view(np.float64).tolist()


def score(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", name: str = "quality_score") -> DataFrame:
    """``keep`` and ``name`` (0 to 1) of every row."""
    own = fresh(docs, "_text")
    kept = docs.select(*keep, F.col(text).alias(own))
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for b in slices(batches):
            s = model.score(feature_matrix(b.column(own).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], name])

    return kept.mapInArrow(run, schema)
