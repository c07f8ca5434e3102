"""Line dedup: repeated multi-line chunks with content-defined boundaries, extended to the whole repeated run of lines.

Of the lines of a text, those with a word are taken. A rolling hash over the hashes of the last two of them opens a new
chunk where it is zero modulo ``MODULUS`` and was not so one line before; boundaries therefore move with the content, not
with its place, and chunks have two lines or more and about four and a half on average. A chunk that occurs more than
once in the table is repeated.

The first and the last chunk of a repeated passage are cut by what surrounds it. Such chunks are made up for by windows
that every line opens: the shortest one of two lines or more with ``LEAST_WORDS`` words, and the longer ones up to where
the next line's shortest ends. Any repeated run of that size is covered by the windows within it, so a match reaches
exactly as far on both sides as its lines are equal. A single line of ``LONG_WORDS`` words or more is a passage too.

Chunks and windows are spans of lines, named by 128 bits of the SHA-256 of their lines' SHA-256. Spans are written once,
16 bytes each besides their place, and grouped after partial aggregation in every task, so a passage that a third of the
documents hold is one row per task. Of the occurrences of a span the first by (doc_id, line) stays. At last the bytes of
all lines in question are compared: where two different lines have one digest, neither goes.

Only built-in functions are used. Defined results: null texts stay null, empty texts empty; blank lines go only inside a
repeated span; a text of which all is removed is the empty string; rows with a null doc_id are never changed and never
the first occurrence; of rows that share a doc_id the first occurrence stays in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._text import fresh, let, stored, words_of

MODULUS = 3
LEAST_WORDS = 20
LONG_WORDS = 50
#: Digests shared by different lines (64 bytes each) that are sent to all tasks. None is known of SHA-256; more are an error.
MOST_UNEQUAL = 1_000


def _digest(line: Column) -> Column:
    return F.sha2(line, 256)


def lines_of(text: Column) -> Column:
    """array<struct<p, d, w>>: place, digest and number of words of every line."""
    # Where blanks stand alone, the words of a line are its blanks and one more.
    plain = ~F.startswith(text, F.lit(" ")) & ~F.endswith(text, F.lit(" "))
    for odd in ("\t", "\x0b", "\x0c", "\r", "  ", " \n", "\n "):
        plain = plain & ~F.contains(text, F.lit(odd))
    blanks = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))

    def rows(count):
        return F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("p"), _digest(x).alias("d"), count(x).alias("w")))

    return F.when(plain, rows(lambda x: F.when(F.octet_length(x) == 0, 0).otherwise(blanks(x) + 1))).otherwise(rows(lambda x: F.size(words_of(x))))


def _window_end(v: Column, i: Column) -> Column:
    """Index of the line with which a window from line i on has two lines and LEAST_WORDS words, or null."""

    def grow(acc: Column, x: Column) -> Column:
        more = (acc["w"] < LEAST_WORDS) | (acc["n"] < 2)
        return F.struct((acc["w"] + F.when(more, x["w"]).otherwise(0)).alias("w"), (acc["n"] + more.cast("int")).alias("n"))

    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"))
    # Every line has a word, so that many lines are enough.
    slow = let(F.aggregate(F.slice(v, i + 1, LEAST_WORDS), none, grow), lambda acc: F.when((acc["w"] >= LEAST_WORDS) & (acc["n"] > 1), i + acc["n"] - 1))
    two = F.get(v, i)["w"] + F.get(v, i + 1)["w"]
    return F.when(two.isNull(), F.lit(None).cast("int")).when(two >= LEAST_WORDS, i + 1).otherwise(slow)


def _pairs(indices: Column, ends) -> Column:
    return F.transform(indices, lambda i, k: F.struct(i.alias("i"), ends(i, k).alias("j")))


def chunks_of(v: Column) -> Column:
    """array<struct<i, j>>: first and last index of the content-defined chunks of two lines or more."""
    rolled = F.transform(v, lambda x, i: F.pmod(F.xxhash64(F.get(v, i - 1)["d"], x["d"]), F.lit(MODULUS)) == 0)

    def cut(zero: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(zero, i) & ~F.get(zero, i - 1)))
        chunks = let(places, lambda p: _pairs(p, lambda i, k: F.coalesce(F.get(p, k + 1), F.size(v)) - 1))
        return F.filter(chunks, lambda c: c["j"] > c["i"])

    return F.when(F.size(v) > 1, let(rolled, cut)).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def windows_of(v: Column) -> Column:
    """array<struct<i, j>>: the windows that every line opens, and the long lines."""

    def from_line(j: Column, i: Column, ends: Column) -> Column:
        upto = F.greatest(j, F.coalesce(F.get(ends, i + 1), F.size(v)) - 1)
        return _pairs(F.sequence(j, upto), lambda e, _: i)

    def windows(ends: Column) -> Column:
        none = F.array().cast("array<struct<i:int,j:int>>")
        found = F.flatten(F.transform(ends, lambda j, i: F.when(j.isNull(), none).otherwise(from_line(j, i, ends))))
        return F.transform(found, lambda s: F.struct(s["j"].alias("i"), s["i"].alias("j")))

    long = F.filter(F.transform(v, lambda x, i: F.when(x["w"] >= LONG_WORDS, F.struct(i.alias("i"), i.alias("j")))), lambda s: s.isNotNull())
    return F.concat(let(F.transform(v, lambda x, i: _window_end(v, i)), windows), long)


def spans_of(text: Column) -> Column:
    """array<struct<start, stop, key>>: the chunks and windows of a text by their lines, with the digest of these lines."""

    def named(s: Column, v: Column, lines: Column) -> Column:
        start, stop = F.get(v, s["i"])["p"], F.get(v, s["j"])["p"]
        digests = F.transform(F.slice(lines, start + 1, stop - start + 1), lambda x: x["d"])
        return F.struct(start.alias("start"), stop.alias("stop"), F.unhex(F.substring(F.sha2(F.array_join(digests, ""), 256), 1, 32)).alias("key"))

    def of_lines(lines: Column) -> Column:
        return let(F.filter(lines, lambda x: x["w"] > 0), lambda v: F.transform(F.concat(chunks_of(v), windows_of(v)), lambda s: named(s, v, lines)))

    return let(lines_of(text), of_lines)


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, stop and key of every span of every row with a doc_id."""
    found = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(spans_of(F.col(text))).alias("s"))
    return found.select("doc_id", "s.*")


def repeated(found: DataFrame) -> DataFrame:
    """key and first_id (the smallest doc_id) of every span that occurs more than once."""
    by_key = found.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return by_key.where("n > 1").select("key", "first_id")


def _lines_in(spans_: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans_, lambda s: F.sequence(s["start"], s["stop"]))))


def places(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document with repeated spans: doc_id, seen (the places of all their lines) and gone (of those that go, if bytes agree)."""
    found = stored(spans(docs, text), "line-spans")
    met = stored(found.join(repeated(found), "key"), "met-spans")
    # Within the document of the first occurrence, the one that begins first stays, and others may begin within it.
    within = met.where("doc_id = first_id").withColumn("s0", F.min("start").over(Window.partitionBy("doc_id", "key")))
    inside = F.greatest("start", F.col("s0") + F.col("stop") - F.col("start") + 1)
    within = within.select("doc_id", "start", "stop", F.when(F.col("start") != F.col("s0"), inside).alias("own"))
    others = met.where("doc_id != first_id").select("doc_id", "start", "stop", F.col("start").alias("own"))
    goes = F.when(F.col("own") <= F.col("stop"), F.struct(F.col("own").alias("start"), "stop"))
    by_doc = within.union(others).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("seen"), F.collect_set(goes).alias("gone"))
    return stored(by_doc.select("doc_id", _lines_in(F.col("seen")).alias("seen"), _lines_in(F.col("gone")).alias("gone")), "line-places")


def unequal(joined: DataFrame, text: str, seen: str, others: list[str]) -> DataFrame:
    """One row with ``digests``: those under which the lines of ``seen`` show two different texts.

    The other columns are read too, so that the texts are shuffled once for this and for the removal (a reused exchange).
    """
    line = let(F.split(F.col(text), "\n"), lambda lines: F.transform(F.col(seen), lambda p: F.get(lines, p)))
    # Not a plain explode: its filter would make another join, with a shuffle of its own.
    lines = joined.select(F.xxhash64(*(F.col(c) for c in others)).alias("_row"), F.explode_outer(line).alias("line"))
    distinct = lines.groupBy(_digest(F.col("line")).alias("d"), "line").agg(F.max("_row").alias("_row"))
    several = distinct.groupBy("d").agg(F.count("*").alias("n"), F.max("_row").alias("_row")).where("n > 1 and _row is not null and d is not null")
    few = several.select("d").limit(MOST_UNEQUAL + 1).agg(F.collect_list("d").alias("digests"))
    return few.select(F.when(F.size("digests") > MOST_UNEQUAL, F.raise_error(F.lit("too many different lines share a SHA-256"))).otherwise(F.col("digests")).alias("digests"))


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and n_removed (stretches of lines) and removed_chars beside it."""
    own, seen, gone, bad, kept = (fresh(docs, n) for n in ("_id", "_seen", "_gone", "_unequal", "_kept"))
    found = places(docs, text).select(F.col("doc_id").alias(own), F.col("seen").alias(seen), F.col("gone").alias(gone))
    # A hash join at every size: places are few beside the texts of a partition, which need no sorting then.
    joined = docs.join(found.hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left")
    others = [f.name for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant")) and f.name != text]
    both = joined.crossJoin(F.broadcast(unequal(joined, text, seen, others).select(F.col("digests").alias(bad))))
    places_gone = F.coalesce(F.col(gone), F.array().cast("array<int>"))

    def certain(lines: Column) -> Column:
        return F.filter(places_gone, lambda p: ~F.array_contains(F.col(bad), _digest(F.get(lines, p))))

    # Digests are taken again only where some are known to be shared.
    lines = let(F.split(F.col(text), "\n"), certain)
    sure = F.when((F.size(F.col(bad)) == 0) | (F.size(places_gone) == 0), places_gone).otherwise(lines)
    both = both.withColumn(gone, sure)
    left = let(F.col(gone), lambda g: F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains(g, i)))
    cut = both.withColumn(kept, F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(F.col(text)))
    stretches = F.size(F.filter(F.col(gone), lambda i: ~F.array_contains(F.col(gone), i - 1)))
    return cut.select(
        *(F.col(kept).alias(c) if c == text else F.col(c) for c in docs.columns),
        stretches.cast("long").alias(fresh(docs, "n_removed")),
        (F.length(text) - F.length(kept)).cast("long").alias(fresh(docs, "removed_chars")),
    )
