"""JSON-lines sources: strict batch reads, shard globs, bounded streams, manifests and checkpoints."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | StructType) -> DataFrame:
    """Blank lines are skipped; a line that is no object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_shards(spark: SparkSession, folders: list[str], split: str) -> DataFrame:
    """shard_path and text of ``<split>-*.jsonl`` in all folders; any other field, or no file, is an error."""
    paths = [f"{f}/{split}-*.jsonl" for f in folders]
    found = spark.read.json(paths)
    if found.columns != ["text"]:
        raise ValueError(f"exactly one field, text, is expected: {found.columns}")
    return found.select(F.input_file_name().alias("shard_path"), "text")


def stream_jsonl(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The files of a folder as a stream; run it with trigger(availableNow=True) for one bounded pass."""
    return spark.readStream.schema(schema).json(folder)


def read_config(text: str, required: dict[str, type]) -> dict:
    """A TOML document whose required keys have the given types."""
    found = tomllib.loads(text)
    for key, kind in required.items():
        if not isinstance(found.get(key), kind):
            raise ValueError(f"{key} must be a {kind.__name__}")
    if "version" in found and not _is_version(found["version"]):
        raise ValueError("versions are lower-case letters, digits and underscores")
    return found


def _is_version(text: str) -> bool:
    return bool(text) and all(c == "_" or (c.isascii() and (c.isdigit() or c.islower())) for c in text)


def read_manifests(spark: SparkSession, paths: dict[str, str], counters: list[str]) -> DataFrame:
    """repository and its counters from one manifest file each; a missing counter is an error."""
    rows = []
    for name, path in paths.items():
        counts = spark.read.option("multiLine", True).json(path).select("counts.*")
        missing = set(counters) - set(counts.columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
        rows.append((name, *counts.select(*counters).first()))
    return spark.createDataFrame(rows, ["repository", *counters])


def newest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """The ``checkpoint-<step>`` folder with the highest step; the folder may lie in any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    steps = {}
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("checkpoint-") and name.rpartition("-")[2].isdigit():
            steps[int(name.rpartition("-")[2])] = s.getPath().toString()
    return steps[max(steps)] if steps else None


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of ``paths`` that do not exist, all at once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return [p for p in paths if not at(p).getFileSystem(conf).exists(at(p))]
