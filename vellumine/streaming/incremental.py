"""Documents and events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.operators.chunking import coarse_chunks


def hourly_counts(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """``(hour, event_type, n)`` per hour of event time; events later than the watermark allows are dropped by it.

    For append mode: an hour is given once, when the watermark has passed its end, and its state is dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def first_seen(events: DataFrame, key: str, ts: str, late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark: repeated deliveries are dropped with bounded state."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def chunk_stream(docs: DataFrame, target: str, checkpoint: str, id_col: str = "doc_id", ts: str | None = None, late: str = "1 day") -> StreamingQuery:
    """New documents chunked as they come, each once.

    Repeated deliveries are dropped by the stream's own state, spread over the tasks by id: within the
    watermark of ``ts`` if there is an event time, else for ever. Each batch is written to a folder of
    its own and replaces it, so a batch that is run again after a failure adds nothing twice; nothing
    written before is read again.
    """
    once = first_seen(docs, id_col, ts, late) if ts else docs.dropDuplicates([id_col])

    def add(batch: DataFrame, number: int) -> None:
        coarse_chunks(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_to(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """All rows there are now, appended to a Parquet folder exactly once."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
