"""Streams: event windows with watermarks, the last verdict per reviewer, and new files once each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event times without zone are read as UTC instants, as watermarks need TIMESTAMP."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(df: DataFrame, width: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events and their sum per type and window, tumbling or sliding; with ``late`` a watermark bounds the state."""
    df = event_time(df)
    df = df.withWatermark("ts", late) if late else df
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = df.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions per user: events less than ``gap`` apart."""
    df = event_time(df)
    df = df.withWatermark("ts", late) if late else df
    out = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_verdicts(labels: DataFrame) -> DataFrame:
    """The stream of changed verdicts: a row per key whenever a later time text replaces the verdict kept in its state.

    Rows of one key may come in any order and more than once; an older or repeated one changes nothing.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else None
        before = kept
        for part in parts:
            for at, label in zip(part["updated_at_utc"].fillna(""), part["label"].fillna(""), strict=True):
                if kept is None or (at, label) > tuple(kept):
                    kept = (at, label)
        if kept != before:
            state.update(kept)
            yield pd.DataFrame({"run_id": [key[0]], "defect_id": [key[1]], "reviewer_id": [key[2]], "updated_at_utc": [kept[0]], "label": [kept[1]]})

    shape = "run_id string, defect_id string, reviewer_id string, updated_at_utc string, label string"
    return labels.groupBy("run_id", "defect_id", "reviewer_id").applyInPandasWithState(step, shape, "at string, label string", "update", GroupStateTimeout.NoTimeout)


def new_files(spark: SparkSession, folder: str, schema: str, into: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Apply ``work`` to every new Parquet file of ``folder`` and append the result to ``into``; each file counts once, also
    after a restart, as a batch writes a folder of its own that a repeat overwrites."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{into}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
