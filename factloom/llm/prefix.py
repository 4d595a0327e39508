"""Row numbers and running sums over groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(h: Column, parts: int) -> Column:
    """The part, 0 to parts - 1, of a 64-bit hash; parts keep the hash's order."""
    return F.least(F.floor((F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 32) * F.lit(parts)) / F.lit(2**32)), F.lit(parts - 1)).cast("int")


def running(df: DataFrame, group: str, order: list[str], value: str, parts: int) -> DataFrame:
    """Adds to df, within each value of `group` (not null), `seq` (row number from 0) and `start` (sum of `value` before
    the row), in the order of `order`, whose first column is a 64-bit hash.

    The hash cuts each group into `parts` pieces. A window runs inside each piece; the pieces' totals (one row each) are
    summed up in front of it. A group with a third of all rows is `parts` pieces in as many tasks.
    """
    d = df.withColumn("_part", spread(F.col(order[0]), parts))
    totals = d.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_s0"))
    within = Window.partitionBy(group, "_part").orderBy(*order)
    rows = d.withColumn("_n", F.row_number().over(within) - 1).withColumn("_s", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (
        rows.join(offsets, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
        .withColumn("seq", (F.col("_r0") + F.col("_n")).cast("long"))
        .withColumn("start", (F.col("_s0") + F.col("_s")).cast("long"))
        .drop("_part", "_g", "_p", "_r0", "_s0", "_n", "_s")
    )


def pieces(rows: int, rows_each: int = 512, most: int = 65_536) -> int:
    """How many pieces `running` should cut each group into, for a table of so many rows."""
    return max(1, min(most, -(-rows // rows_each)))
