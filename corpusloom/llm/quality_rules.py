"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every count comes from the whole text. Defined results: a null or empty text has zero words, zero of
everything else and is not kept; ties and repeated rows are judged row by row; extra columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._text import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux ce dans des du elle en est et la le les ou par pas pour que qui sur un une "
    "al con del el en es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` is below ``least`` or above ``most``; it binds from ``from_words`` words on."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table. Measures are the columns of :func:`measures`.
RULES = (
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_ratio", most=0.2),
    Rule("stop_ratio", least=0.01, from_words=100),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_ratio", most=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside any five-word window that the text holds twice or more.

    Windows are compared by a 64-bit hash. Only texts that have equal hashes pay for the sort.
    """
    long = F.lit(0).cast("long")

    def spans(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(h: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), long.alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(spans(h), start, step, lambda acc: acc["n"])

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(
            hashes,
            lambda wh: F.transform(
                F.sequence(F.lit(0), F.size(wh) - WINDOW),
                lambda i: F.xxhash64(*(F.get(wh, i + k) for k in range(WINDOW))),
            ),
        )

    repeats = lambda w: let(
        windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), long).otherwise(covered(h))
    )
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, long).otherwise(repeats(w)))


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and, for each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, t.alias("_t")).select(*keep, "_t", words_of(F.col("_t")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    counted = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u"))).alias("_l"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
    )
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    dup = F.col("_l.n") - F.col("_l.u")
    return counted.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        dup.cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        per(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        per(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        per(F.col("_stops"), F.col("n_words")).alias("stop_ratio"),
        per(dup, F.col("_l.n")).alias("dup_line_ratio"),
        per(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"),
    )


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of :func:`measures` breaks, as array<string>."""
    broken = []
    for r in rules:
        c = F.col(r.measure)
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (c < r.least)
        if r.most is not None:
            bad = bad | (c > r.most)
        broken.append(F.when(bad & (F.col("n_words") >= r.from_words), F.lit(r.measure)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """:func:`measures` with base_failed, failed_rules and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        measures(docs, text, keep)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", failed_rules(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
