"""Sharding: global byte prefix sums from per-partition totals, cut at equal targets (law ``bytes``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import scratch

SHARDS = 24


def shard(df: DataFrame, id_col: str, size: Column, n_shards: int, carry: list[str] | None = None) -> DataFrame:
    """Contiguous shards, in the order of `id_col`, of nearly equal size.

    Returns _id, _size, _shard (0 to n_shards - 1), _slot (row number in the shard, from 0) and _row, a struct of the columns
    `carry` whatever their names. A row goes to the shard in whose byte range its middle lies, so a shard differs from the
    equal share by one row's size at most. Null ids come first; rows of one id, however many, follow each other by size and by
    a hash of what they carry, and equal rows are interchangeable; each keeps its own place. A row larger than a shard's share
    leaves the shards that it covers empty. An empty table gives no row. Only sizes and carried columns are shuffled: a text
    of any length is read where it lies.

    Rows are dealt by ranges of the order and staged with their partition's number, which fixes the ranges; each partition
    gets one window, and only its totals (a row a partition) meet in one task.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(id_col).alias("_id"), size.cast("long").alias("_size"), F.struct(*(carry or [F.lit(None).cast("int").alias("none")])).alias("_row")).withColumn("_tie", F.xxhash64("_row"))
    order = [F.col("_id").asc_nulls_first(), F.col("_size"), F.col("_tie")]
    dealt = scratch.stage(narrow.repartitionByRange(scratch.partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "sharding-rows")
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(F.col("_part").alias("p"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.sum("bytes").over(whole).alias("total"))
    within = Window.partitionBy("_part").orderBy(*order)
    placed = (
        dealt.join(scratch.small(offsets, "sharding-offsets"), F.col("_part") == F.col("p"))
        .withColumn("at", F.col("row0") + F.row_number().over(within) - 1)
        .withColumn("middle", 2 * (F.col("byte0") + F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))) - F.col("_size"))
        # DECIMAL: the product of bytes and shards may pass a long; a total of no bytes makes one shard
        .withColumn("_shard", F.least(F.lit(n_shards - 1), F.coalesce(F.expr(f"try_divide(cast(middle as decimal(25, 0)) * {int(n_shards)}, cast(2 * total as decimal(25, 0)))"), F.lit(0)).cast("long")).cast("int"))
        .select("_id", "_row", "_size", "at", "_shard")
    )
    firsts = placed.groupBy(F.col("_shard").alias("s")).agg(F.min("at").alias("first"))  # a row a shard
    return placed.join(scratch.small(firsts, "sharding-firsts"), F.col("_shard") == F.col("s")).select("_id", "_row", "_size", "_shard", (F.col("at") - F.col("first")).cast("long").alias("_slot"))


def write_shards(df: DataFrame, id_col: str, size: Column, n_shards: int, path: str) -> None:
    """Writes df's rows, each once, under path/shard=N; a column of df that is itself named shard is written as own_shard."""
    at = shard(df, id_col, size, n_shards, df.columns)
    own = [F.col("_row")[c].alias("own_shard" if c.lower() == "shard" else c) for c in df.columns]
    at.select(*own, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards by bytes: a row's size is its text's UTF-8 bytes (null: none) plus 8. A null text's
    checksum is that of no bytes, 0. Equal texts are not held together: the law deals bytes, and a text may repeat without bound."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("bytes"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = shard(sized, "doc_id", F.col("bytes"), SHARDS, ["text_crc32"])
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "_row.text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The checksum's table from its rule (the reflected polynomial 0xEDB88320), then a fold over the bytes of each text.
ORACLE = f"""
with recursive steps(i, n, c) as (select i, 0, i::bigint from range(256) t(i) union all select i, n + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end from steps where n < 8),
tab as (select list(c order by i) as crc from steps where n = 8),
d as (select doc_id, encode(coalesce(text, '')) as raw, octet_length(encode(coalesce(text, ''))) + 8 as size from documents),
h as (select doc_id, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::bigint) as bytes from d),
k as (select doc_id, xor(list_reduce(list_concat([4294967295::bigint], bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::bigint)::bigint as text_crc32 from h, tab),
p as (select doc_id, size, sum(size) over (order by doc_id) as upto, sum(size) over () as total from d),
s as (select doc_id, size, least({SHARDS - 1}, (2 * upto - size) * {SHARDS} // (2 * total))::int as shard from p)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, null::int as grown_shard
from s join k using (doc_id)
"""
