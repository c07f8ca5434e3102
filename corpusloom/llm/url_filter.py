"""URL filter: allow and block rules, and for the rest a logistic regression on hashed character n-grams.

The model is fitted on a small labelled table of URLs (:func:`labelled_urls`, or the caller's). Its features are
made by Spark functions, both for the few labelled rows and for the data, so that they agree; the
weights enter the scoring projection as one array literal.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the model on the empty string. Ties between rules of equal length go to the first listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._text import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATTERN = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
GRAMS = (3, 4, 5)
DIM = 2048

# Words of host names, as lists of blocked and of useful sites have them.
BLOCK_WORDS = (
    "adult bet bingo cams casino cheap crack dating escort free fuck gamble hentai hookup jackpot keygen loan lottery "
    "meds money naked nude payday pharmacy pills poker porn prize replica sex slots spin torrent viagra warez win xxx"
).split()
ALLOW_WORDS = (
    "academy archive art bakery blog book city clinic college council docs forum garden gazette guide history hospital "
    "journal lab law library market math museum music news park photo press recipes research review school science studio travel weather"
).split()
#: The same for both labels, so that the fit looks at names.
ENDINGS = "com net org info eu co.uk".split()
PREFIXES = ("", "www.", "m.", "shop.", "blog.")
PATHS = ("", "/", "/en/1", "/2024/05/page.html", "/de/index", "/item?id=7", "/fr/22/")
SYLLABLES = "ba den ka lor mi nes pu ra sta tel vo wen zi".split()


def labelled_urls() -> tuple[tuple[str, int], ...]:
    """(url, label), 1 = block: names of two words of one list, or of invented syllables, which are allowed."""
    names = [(f"{ws[i]}{'-' if k % 2 else ''}{ws[(i + k) % len(ws)]}", label) for label, ws in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)) for k in (1, 4, 9) for i in range(len(ws))]
    n = len(SYLLABLES)
    names += [(SYLLABLES[i % n] + SYLLABLES[(i // n + 3 * i) % n] + SYLLABLES[(5 * i + 2) % n], 0) for i in range(120)]
    return tuple((f"https://{PREFIXES[i % 5]}{name}.{ENDINGS[i % 6]}{PATHS[i % 7]}", label) for i, (name, label) in enumerate(names)) + (("https://", 0),)


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains when the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PATTERN, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATTERN, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def gram_slots(host: Column, path: Column, dim: int = DIM) -> Column:
    """The slots of all character n-grams of ``^host$`` and of the path, as array<bigint>."""

    def slots(text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(n))), F.lit(dim)))

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    return let(marked, lambda h: let(path, lambda p: F.concat(*(slots(t, n) for t in (h, p) for n in GRAMS))))


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]

    def probability(self, slots: Column) -> Column:
        w = F.lit(list(self.weights))
        total = F.aggregate(slots, F.lit(0.0), lambda acc, k: acc + F.get(w, k.cast("int")))
        scaled = F.lit(self.bias) + F.coalesce(F.try_divide(total, F.sqrt(F.size(slots).cast("double"))), F.lit(0.0))
        return 1 / (1 + F.exp(-scaled))


def fit(spark: SparkSession, labelled: tuple[tuple[str, int], ...] | None = None, dim: int = DIM, rounds: int = 400, rate: float = 2.0, decay: float = 1e-3) -> UrlModel:
    """Gradient descent on the logistic loss, so that names like none of the table get the share of the blocked. ``labelled`` is a table in the caller's hands, so small."""
    rows = spark.createDataFrame(list(labelled_urls() if labelled is None else labelled), "url string, label int")
    got = rows.select("label", gram_slots(host_of(F.col("url")), path_of(F.col("url")), dim).alias("slots")).collect()
    x, y = np.zeros((len(got), dim)), np.array([r["label"] for r in got], float)
    for row, r in zip(x, got, strict=True):
        np.add.at(row, r["slots"], 1 / math.sqrt(max(1, len(r["slots"]))))
    bias, w = 0.0, np.zeros(dim)
    for _ in range(rounds):
        pull = (1 / (1 + np.exp(-bias - x @ w)) - y) / max(1, len(y))
        bias -= rate * float(pull.sum())
        w -= rate * (pull @ x + decay * w)
    return UrlModel(bias, tuple(w.tolist()))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...], model: UrlModel, url: str = "url", keep: tuple[str, ...] = ("page_id",), threshold: float = 0.5) -> DataFrame:
    """``keep``, host, path, rule, block_probability and verdict of every row."""
    parts = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = parts.select(
        "*",
        rule_of(F.col("host"), F.col("path"), rules).alias("_r"),
        let(gram_slots(F.col("host"), F.col("path"), len(model.weights)), model.probability).alias("block_probability"),
    )
    by_model = F.when(F.col("block_probability") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(*keep, "host", "path", F.col("_r.rule").alias("rule"), "block_probability", F.coalesce(F.col("_r.verdict"), by_model).alias("verdict"))


