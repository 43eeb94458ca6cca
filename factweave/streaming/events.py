"""Event streams: windows with a watermark, and the last write before each read as a stateful operator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factweave.session import ensure_checkpoint_dir


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; rows later than `late` behind the newest are left out, as streams must."""
    marked = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = marked.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("opened"), "event_type", "n", "most")


def sliding_counts(events: DataFrame, window: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """As windowed_counts over sliding windows."""
    marked = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = marked.groupBy(F.window("at", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("opened"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: runs of events with pauses under `gap`."""
    marked = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = marked.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("opened"), F.col("s.end").cast("timestamp_ntz").alias("closed"), "n")


def last_writes(events: DataFrame, write: str = "purchase", read: str = "view") -> DataFrame:
    """Each read with the last write of its user that came before it: (event_id, user_id, last_write).

    State is one event id per user. Within a batch rows follow (ts, event_id); a row that arrives in a later
    batch than its place in time is taken when it arrives.
    """

    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: Any = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"]):
            if kind == read:
                out.append((event_id, key[0], last))
            elif kind == write:
                last = event_id
        if last is not None:
            state.update((int(last),))
        if out:
            yield pd.DataFrame({"event_id": [r[0] for r in out], "user_id": [r[1] for r in out], "last_write": pd.array([r[2] for r in out], dtype="Int64")})

    slim = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    shape = "event_id bigint, user_id bigint, last_write bigint"
    return slim.groupBy("user_id").applyInPandasWithState(track, shape, "last bigint", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """What a stream of everything that is there now leaves in an append sink, as a table in the shared folder."""
    home = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    q = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int | None = None) -> DataFrame:
    """The files of a folder that bear the name, as a stream with the schema of what is there."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
