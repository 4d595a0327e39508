"""All pairs that lead to each other over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources import store


def closure(links: DataFrame) -> DataFrame:
    """(a, b): all pairs that one link (a, b) or more lead over.

    Known pairs are those of up to n steps, and jumps those of n steps exactly: a jump and a known pair are n + 1 to 2 n steps.
    So n doubles each round, and on a tree each pair is made once. A cycle ends where no new pair comes.
    """
    known = jumps = store.cut(links.distinct())
    while True:
        after = lambda d: jumps.select("a", F.col("b").alias("via")).join(d.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()  # noqa: B023, E731
        new = store.cut(after(known).join(known, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return known
        known, jumps = known.union(new), store.cut(after(jumps))
        if jumps.isEmpty():
            return known
