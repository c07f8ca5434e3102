"""Structured Streaming: event-time windows with late data, and exact stateful selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """window_start, event_type, n and total of a stream (or table) with ts, event_type and value."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = stamped.withWatermark("ts", late) if events.isStreaming else stamped
    grouped = marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def select_negatives(rows: DataFrame, share_of: int, out_of: int, phase: int = 0) -> DataFrame:
    """Of a stream of (source, label, ...) rows all positives, and ``share_of`` in every ``out_of`` negatives of a source.

    The remainder is the state of the source and lives in the checkpoint, so a restart goes on exactly.
    """
    schema = rows.schema

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        left = state.get[0] if state.exists else phase
        for frame in frames:
            keep = []
            for label in frame["label"]:
                if label == 1:
                    keep.append(True)
                    continue
                left += share_of
                keep.append(left >= out_of)
                left -= out_of * keep[-1]
            yield frame[keep]
        state.update((left,))

    return rows.groupBy("source").applyInPandasWithState(step, schema, "left long", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """One bounded pass into Parquet; a second call takes only what came since."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
