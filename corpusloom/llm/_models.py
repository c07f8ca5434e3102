"""Bounded samples of labelled rows, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_per_class(rows: DataFrame, label: str, per_class: int, max_classes: int = 256) -> DataFrame:
    """About ``per_class`` rows of each label (all, if fewer), chosen by a hash of doc_id; one row for each doc_id and label.

    The hash gives every row its own number in [0, 1); a row is taken when that is below
    per_class / (rows of its label), so no sort or shuffle of rows is needed and the result has
    about per_class * classes rows at every size. More than ``max_classes`` labels are an error.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).limit(max_classes + 1).collect()}
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}")
    rate: Column = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == value, F.lit(min(1.0, per_class / n))).otherwise(rate)
    number = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(number < rate).dropDuplicates(["doc_id", label])
