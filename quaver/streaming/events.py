"""Event-time operators, one definition for batch and stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, began, last, n_events): runs of activity with less than ``gap`` between events.

    On a stream the zoneless time becomes a timestamp, which a watermark needs.
    """
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    s = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.min("ts").alias("began"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n_events"))
    return s.select("user_id", "began", "last", "n_events")


def owned_windows(events: DataFrame, core: str = "1 hour", context: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(core, seen, owned): windows of ``core`` with ``context`` (shorter than a core) on both sides; ``owned`` counts the rows in the core only."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    size, near = (int(x.total_seconds() * 1e6) for x in (pd.Timedelta(core), pd.Timedelta(context)))
    us = F.unix_micros("at")
    begin = lambda x: F.timestamp_micros(F.floor(x / size).cast("long") * size)
    spread = rows.withColumn("own", begin(us)).withColumn("core", F.explode(F.array_distinct(F.array(begin(us), begin(us - near), begin(us + near)))))
    return spread.groupBy("core").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("own") == F.col("core")).alias("owned"))


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """One row of each key within the watermark (late copies are dropped)."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])


def start(df: DataFrame, name: str, folder: str, mode: str = "append") -> DataStreamWriter:
    """A writer that stops when the input is read, with its checkpoint in ``folder``."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True)
