"""Operators over streams: windowed counts with a watermark, and bounded reordering of sorted-by-position records."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of a stream or table of (ts, event_type, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = timed.withWatermark("ts", late) if events.isStreaming else timed
    return kept.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what its source holds now, into a table in memory: for small results and tests."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def windowed_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source wants a folder or a pattern; this one is just the events.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(path.replace("events.parquet", "events*parquet"))
    return run_to_end(windowed_counts(stream)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def reordered(records: DataFrame, look_back: int, columns: str) -> DataFrame:
    """A stream (contig, start, ...) in order within each contig: a record is held until one ``look_back`` positions further on is seen.

    A record that comes later than that is an error, since what follows it has been sent already. ``columns`` is the schema as DDL.
    """
    names = records.columns
    at = names.index("start")

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, sent = state.get if state.exists else ("[]", -1)
        frames = [pd.read_json(io.StringIO(held), orient="values", dtype=False), *(f[names] for f in batches)]
        frames[0].columns = names if len(frames[0]) else frames[0].columns
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=names)], ignore_index=True)
        rows = rows.sort_values("start", kind="stable", ignore_index=True)
        if len(rows) and rows.iloc[0, at] < sent:
            raise ValueError(f"a record at {rows.iloc[0, at]} came after {sent} was sent")
        out = rows[rows["start"] <= rows["start"].max() - look_back] if len(rows) else rows
        rest = rows.iloc[len(out) :]
        state.update((rest.to_json(orient="values"), int(max([sent, *out["start"].tail(1)]))))
        yield out

    return records.groupBy("contig").applyInPandasWithState(step, columns, "held string, sent bigint", "append", GroupStateTimeout.NoTimeout)
