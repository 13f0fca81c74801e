"""Windows over a stream of events; each also runs on a batch frame, with the same result. No part of the register's parity."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.stored import shared_dir

WATERMARK = "1 hour"


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", watermark) if events.isStreaming else timed


def tumbling(events: DataFrame, length: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """(start, event_type, n, total) by windows of a length; late rows beyond the watermark are left out of a stream."""
    g = _timed(events, watermark).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """(user_id, start, n) of runs of a user's events with no longer gap."""
    g = _timed(events, watermark).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def closing(events: DataFrame, after: str = "2 days") -> DataFrame:
    """One event so much later than all others that every window before it is over. Its own window never closes."""
    last = events.agg(F.max("ts").alias("ts_")).select((F.col("ts_") + F.expr(f"interval {after}")).alias("ts_"))
    return last.filter("ts_ is not null").select(*[F.col("ts_").cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields])


def run(spark: SparkSession, build: Callable[[DataFrame], DataFrame], source: str, schema: StructType, out: str, checkpoint: str, files: int | None = None) -> None:
    """Process what lies in folder `source` and isn't processed yet, `files` files a batch, and append closed windows to `out`.

    Offsets and open windows are in `checkpoint`: a run that is stopped, or lost with its driver, goes on where it was, and no
    window is written twice.
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    query = build(reader.parquet(source)).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def streamed(events: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """build over events as a stream in two runs: all events, then, from the checkpoint, the closing one. Equal to build(events)."""
    spark, folder = events.sparkSession, f"{shared_dir(events.sparkSession)}/tallyloom/stream-{uuid.uuid4().hex}"
    parts = f"{folder}/in", events.schema, f"{folder}/out", f"{folder}/checkpoint"
    events.write.parquet(parts[0])
    run(spark, build, *parts)
    closing(events).coalesce(1).write.mode("append").parquet(parts[0])
    run(spark, build, *parts)
    return spark.read.parquet(parts[2])
