"""Streaming operators, each run as a stream over the event files and as a table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.fixtures import table
from factloom.plans.register import query
from factloom.sources import store
from factloom.streaming import events as stream


def _drained(spark: SparkSession, d: str, make) -> DataFrame:
    """The rows that make(stream) appended once all event files were read; they and the checkpoint lie in the shared folder."""
    folder = store.new_folder(spark)
    rows = make(_read(spark, d))
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def _read(spark: SparkSession, d: str) -> DataFrame:
    """The event files as a stream; a single file is found by its name in the folder."""
    path = f"{d}/events.parquet"
    schema = table(spark, d, "events").schema
    single = spark._jvm.org.apache.hadoop.fs.Path(path)
    if single.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(single):
        return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.read(spark, path, schema)


@query("x_trace_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as cost from events group by 1, 2")
def _(spark, d):
    return stream.trace(table(spark, d, "events"))


@query("x_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as head from events), s as (select *, sum(head) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def _(spark, d):
    return stream.sessions(table(spark, d, "events"))


@query("x_distinct_events", "select event_id, count(*) as n from (select distinct event_id from events) group by 1")
def _(spark, d):
    """Every event comes twice; the stream lets each through once."""
    once = _drained(spark, d, lambda s: stream.distinct_events(s.union(s), "100 days"))
    return once.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("x_ingest", "select doc_id, case when doc_id % 3 = 0 then 'new' else 'old' end as version from documents where length(text) > 0")
def _(spark, d):
    """Two batches of documents through the ingestion: the second holds a third of them anew, whose rows replace the older ones."""
    folder = store.new_folder(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_ref"), "text")
    docs.withColumn("version", F.lit("old")).write.parquet(f"{folder}/first")
    docs.where("paper_ref % 3 = 0").withColumn("version", F.lit("new")).write.parquet(f"{folder}/second")
    for n in ("first", "second"):
        rows = spark.readStream.schema("paper_ref string, text string, version string").parquet(f"{folder}/{n}")
        stream.ingest_documents(rows, f"{folder}/papers", f"{folder}/states-{n}", f"{folder}/log-{n}", lambda b: b.where("length(text) > 0").select("paper_ref", "version")).awaitTermination()
    return store.read_version(spark, f"{folder}/papers").select(F.col("paper_ref").cast("long").alias("doc_id"), "version")
