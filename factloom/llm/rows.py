"""Rows of documents whatever their ids and columns: marked by id and hash, and the first of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(2**63)


def mark(docs: DataFrame) -> DataFrame:
    """_id (doc_id, with a stand-in for null), _h (the hash of the whole row), text, and _row, docs' columns whatever their names."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID).cast("long")).alias("_id"), F.xxhash64(*docs.columns).alias("_h"), "text", F.struct(*docs.columns).alias("_row"))


def first_of_each(marked: DataFrame, rows: DataFrame, names: list[str]) -> DataFrame:
    """Of marked docs, one row for each component of rows (_id, _h, component): the smallest _id's, null last, then the smallest hash's."""
    order = F.struct(F.col("_id") == NO_ID, "_id", "_h")
    stay = rows.groupBy("component").agg(F.min(order).alias("o")).select(F.col("o._id").alias("i"), F.col("o._h").alias("h"))
    kept = marked.join(stay, (F.col("_id") == F.col("i")) & (F.col("_h") == F.col("h"))).dropDuplicates(["_id", "_h"])
    return kept.select(*[F.col("_row")[c].alias(c) for c in names])
