"""Structured Streaming over event files: windowed traces with a watermark, deduplication, idempotent ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import store


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    """events with `ts` as a point in time, as watermarks want it, of the session's time zone if it was written without one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def trace(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and cost by window and stage; works on a stream and on a table."""
    e = timed(events).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("cost"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "cost")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each user without a pause of `gap`."""
    e = timed(events).withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def status(rows: DataFrame, reading: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(paper_ref, state, n) of documents (paper_ref, ...) that `reading` turned into rows (paper_ref, ...): done with their number,
    or unsupported where it made none."""
    n = reading(rows).groupBy("paper_ref").agg(F.count(F.lit(1)).alias("n"))
    told = rows.select("paper_ref").distinct().join(n, "paper_ref", "left")
    return told.select("paper_ref", F.when(F.col("n").isNull(), "unsupported").otherwise("done").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


def ingest_documents(stream: DataFrame, path: str, log: str, checkpoint: str, reading: Callable[[DataFrame], DataFrame]):
    """Puts what `reading` makes of each batch of documents (paper_ref, ...) into the table under path, in place of their older rows,
    and writes a log of states. Of a document that comes twice in a batch the rows of both come from one reading. A batch that
    is run again replaces the same documents with the same rows, and its log folder is overwritten. A batch that fails is
    logged with its error and stops the stream."""

    def run(batch: DataFrame, number: int) -> None:
        own = batch.persist()
        try:
            store.save(reading(own), path)
            status(own, reading).withColumn("error", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{log}/batch={number}")
        except Exception as e:
            failed = own.select("paper_ref").distinct().select("paper_ref", F.lit("error").alias("state"), F.lit(0).cast("long").alias("n"), F.lit(repr(e)[:100]).alias("error"))
            failed.write.mode("overwrite").parquet(f"{log}/batch={number}")
            raise
        finally:
            own.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def progress(query) -> dict:
    """What a running ingestion tells who polls it: whether it is active, and its last batch's number and rows."""
    last = query.lastProgress or {}
    return {"active": query.isActive, "batch": last.get("batchId"), "rows": last.get("numInputRows")}


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch to its own folder; a batch that is run again overwrites what it wrote."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
