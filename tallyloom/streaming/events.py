"""Streams over the events table: files are read as they arrive, results are kept in the shared folder.

Every stream runs with availableNow, a checkpoint location of its own, append mode and a watermark, so its state is bounded by
the delay it allows: windows and sessions are given out once they can no longer change, rows later than the watermark are
dropped, and a user's last event is forgotten after the same delay. Its batch twin (SQL) gives what is closed by then."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.session import scratch, ship

#: A user's last event is kept so long after it.
FORGET_MS = 86_400_000
PAIR = "user_id bigint, winner string, loser string, margin double, event_id bigint"


def stream(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """The events as a stream; rows later than the watermark are dropped by the stateful operators."""
    ship(spark)
    at = f"{sf_dir}/events*.parquet"  # files or folders of them
    s = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 100).parquet(at)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run(df: DataFrame, at: str | None = None) -> DataFrame:
    """Run to the end of what is there and read all that was given out so far; a second run at the same place goes on."""
    spark, at = df.sparkSession, at or scratch(df.sparkSession)
    w = df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{at}-checkpoint")
    w.format("parquet").option("path", at).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(at)


def tumbling(s: DataFrame, width: str = "1 hour") -> DataFrame:
    g = s.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(s: DataFrame, width: str = "6 hours", step: str = "2 hours") -> DataFrame:
    g = s.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(s: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = s.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def _pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Emit a preference whenever two neighbouring events of a user differ in type: the higher value wins. A row older than
    the user's last one is late; a user without events for the allowed delay is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    last = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for t, v, i, at in zip(rows["event_type"], rows["value"], rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64")):
        if last is not None and at < last[2]:
            continue
        if last is not None and last[0] != t and v == v and last[1] == last[1]:
            w, o = ((t, last[0]) if v > last[1] else (last[0], t))
            out.append((key[0], w, o, abs(float(v) - last[1]), int(i)))
        last = (t, float(v), int(at))
    if last is not None:
        state.update(last)
        state.setTimeoutTimestamp(max(last[2] // 1000, state.getCurrentWatermarkMs()) + FORGET_MS)
    yield pd.DataFrame(out, columns=["user_id", "winner", "loser", "margin", "event_id"])


def preference_pairs(s: DataFrame) -> DataFrame:
    """Stateful: the last event of each user, for as long as the delay, is all that is kept."""
    return s.groupBy("user_id").applyInPandasWithState(_pairs, PAIR, "event_type string, value double, at bigint", "append", GroupStateTimeout.EventTimeTimeout)
