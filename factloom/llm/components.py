"""Connected components of a graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import scratch


def _mins(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in the links (u, v), two longs; component: the smallest id that can be reached.

    Alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond"): every round points the larger
    neighbours of each node to the smallest one, then the smaller neighbours too, and is written to the shared folder;
    minima are combined before they are shuffled, and tables of the rounds before are deleted. Ends when a round changes nothing.
    No links: no rows.
    """
    state = scratch.stage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components-0")

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(state)
    if not seen[0]:
        return state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for n in range(1, max_rounds):
        older = state
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _mins(both).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.stage(large, f"components-{n}a")
        low = _mins(large)
        small = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = scratch.stage(small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), f"components-{n}b")
        scratch.drop(large, older)
        now = mark(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(state.select(F.col("v"), F.col("v")).distinct())
