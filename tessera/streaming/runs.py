"""The run log as a stream: windows, sessions, de-duplication, a rate limiter, and a helper to drain a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.cluster import shared_dir


def shared(spark: SparkSession) -> str:
    """A new folder under the one that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream, its times as timestamps."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and window of event time; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def distinct(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def limited(stream: DataFrame, key: str = "user_id", at: str = "ts", burst: float = 60, per_second: float = 1.0) -> DataFrame:
    """(key, ts, allowed): each key's bucket refills at a rate, and a request takes a token if there is one.

    A bucket is two numbers, so state stays small, and a hot key's rows pass through in batches.
    """

    def run(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(burst), None)
        for rows in batches:
            rows, allowed = rows.sort_values(at, kind="stable"), []
            for t in rows[at]:
                now = t.timestamp()
                tokens = tokens if last is None else min(float(burst), tokens + max(0.0, now - last) * per_second)
                last = now if last is None else max(last, now)
                allowed.append(tokens >= 1)
                tokens -= float(tokens >= 1)
            yield pd.DataFrame({key: k[0], at: rows[at], "allowed": allowed})
        state.update((tokens, last))

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {at} timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs what the stream holds now to its end, and reads back what it wrote.

    append writes files; update keeps what each batch changed, of which a key's last row counts (``keys``), so the stream
    itself holds no more state than its watermark asks for; complete writes the whole result with every batch.
    """
    spark = stream.sparkSession
    folder = shared(spark)
    out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    if mode == "append":
        query = out.format("parquet").option("path", f"{folder}/rows").start()
    elif mode == "update":
        query = out.foreachBatch(lambda rows, i: rows.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{folder}/rows")).start()
    else:
        query = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    rest = [c for c in stream.columns if c not in (keys or [])]
    rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*")
