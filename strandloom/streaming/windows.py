"""Structured Streaming over events: windows, sessions, duplicates, and hits clustered as they come."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.session import ensure_checkpoints


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "id_sum")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; the key is forgotten once the watermark is `late` beyond it, so that the state stays bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def clustered(hits: DataFrame) -> DataFrame:
    """Per sequence the number of hits, their outer range and the clusters of overlapping ones so far, kept as state across batches."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ranges = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in parts:
            ranges += list(zip(pdf["query_start"].tolist(), pdf["query_end"].tolist(), [1] * len(pdf), strict=True))
        merged: list[list[int]] = []
        for s, e, n in sorted(ranges):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
                merged[-1][2] += n
            else:
                merged.append([s, e, n])
        state.update(tuple([m[k] for m in merged] for k in range(3)))
        yield pd.DataFrame({"query_name": [key[0]], "n_clusters": [len(merged)], "n_hits": [sum(m[2] for m in merged)], "lo": [merged[0][0]], "hi": [max(m[1] for m in merged)]})

    return hits.groupBy("query_name").applyInPandasWithState(step, "query_name string, n_clusters long, n_hits long, lo long, hi long", "starts array<long>, ends array<long>, ns array<long>", "update", GroupStateTimeout.NoTimeout)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A stream's state lies in the folder that driver and executors share."""
    ensure_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/streams/{name}"


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that there is, as a table: batches are written by the executors as Parquet, of complete ones the last counts."""
    spark = stream.sparkSession
    place = checkpoint_path(spark, f"stream_{uuid.uuid4().hex}")
    written: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{place}-rows/{number}"
        batch.write.mode("overwrite").parquet(path)
        if path not in written:
            written.append(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(written[-1:] if mode == "complete" else written))


def for_each(hits: DataFrame, consume: Callable[[DataFrame], None]):
    """Each micro-batch of a stream to a function."""
    place = checkpoint_path(hits.sparkSession, f"stream_{uuid.uuid4().hex}")
    return hits.writeStream.foreachBatch(lambda df, _: consume(df)).option("checkpointLocation", place).trigger(availableNow=True).start()
