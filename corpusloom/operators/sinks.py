"""Sinks: canonical JSON, sharded documents with aligned provenance, staged publishing, logs and cards."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(columns: list[str]) -> Column:
    """Fields in alphabetical order, nulls kept, no blanks, non-ASCII characters as they are."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def guard_absent(spark: SparkSession, paths: list[str]) -> None:
    """Versions are written once: any target that exists is an error."""
    for path in paths:
        fs, p = _path(spark, path)
        if fs.exists(p):
            raise FileExistsError(path)


def write_shards(documents: DataFrame, folder: str) -> None:
    """``documents`` (split, shard, row_index, text): one ``split=/shard=`` folder with one file of {"text"} rows each, in order."""
    rows = documents.select("split", "shard", "row_index", F.to_json(F.struct("text")).alias("value"))
    rows.repartition("split", "shard").sortWithinPartitions("split", "shard", "row_index").drop("row_index").write.partitionBy("split", "shard").text(folder)


def write_provenance(documents: DataFrame, columns: list[str], folder: str) -> None:
    """The rows beside :func:`write_shards`, in the same folders and order."""
    rows = documents.select("split", "shard", "row_index", canonical_json([*columns, "row_index"]).alias("value"))
    rows.repartition("split", "shard").sortWithinPartitions("split", "shard", "row_index").drop("row_index").write.partitionBy("split", "shard").text(folder)


def write_split_tasks(records: DataFrame, folder: str) -> None:
    """Records with task and split columns as JSON, one folder for each pair."""
    records.write.partitionBy("task", "split").json(folder)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("compression", "gzip").json(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """Metrics as JSON; NaN is an error."""
    numbers = [c for c, t in rows.dtypes if t in ("double", "float")]
    bad = rows.where(" or ".join(f"isnan(`{c}`)" for c in numbers)).limit(1).count() if numbers else 0
    if bad:
        raise ValueError("a metric is not a number")
    rows.write.mode("errorifexists").json(path)


def publish(spark: SparkSession, parts: dict[str, DataFrame | Callable[[str], None]], staging: str, targets: dict[str, str], check=None) -> None:
    """Write all parts to a staging folder, check them there, then rename each to its target, the last one last.

    A part is a DataFrame, written as Parquet, or a function that writes to the path it is given.

    ``check(spark, {name: staged path})`` raises if something is wrong; nothing is published then.
    """
    guard_absent(spark, list(targets.values()))
    root = f"{staging}/{uuid.uuid4().hex}"
    staged = {name: f"{root}/{name}" for name in parts}
    try:
        for name, df in parts.items():
            df(staged[name]) if callable(df) else df.write.parquet(staged[name])
        if check:
            check(spark, staged)
        for name, target in targets.items():
            fs, p = _path(spark, target)
            fs.mkdirs(p.getParent())
            if not fs.rename(_path(spark, staged[name])[1], p):
                raise OSError(f"{target} could not be published")
    finally:
        fs, p = _path(spark, root)
        fs.delete(p, True)


def summary(manifests: DataFrame) -> DataFrame:
    """Rows (repository, train, validation) with their total."""
    sums = manifests.rollup("repository").agg(F.grouping("repository").alias("_all"), F.sum("train").alias("train"), F.sum("validation").alias("validation"))
    return sums.select(F.when(F.col("_all") == 1, "total").otherwise(F.col("repository")).alias("repository"), "train", "validation")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown."""
    found = rows.limit(most).collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in found)


def report(row: DataFrame) -> str:
    """One row as indented JSON with sorted keys."""
    return json.dumps(row.first().asDict(True), indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"
