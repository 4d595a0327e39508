"""Packing: length buckets that minimise padding over the global histogram, and token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import columns, prefix, scratch

BUCKETS, BUDGET, SEED = 12, 65_536, 11


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bucket boundaries (largest length of each, ascending) with the least padding in all.

    best[k][j] = min over i of best[k-1][i] + cost(i, j), where one bucket of the lengths i to j-1 costs
    counts * (its largest length) - tokens. The best i grows with j (the cost has the Monge property), so halving the
    range of j, all ranges of a level at once, needs n log n steps for each bucket; equal costs take the smaller i, fewer
    buckets if they are as good. Sums are 64-bit integers.
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(x)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best, cuts = np.concatenate([[0], x * rows[1:] - tokens[1:]]), []
    for _ in range(1, min(buckets, n)):
        new, at = best.copy(), np.zeros(n + 1, np.int64)
        lo, hi, a, b = (np.array([v], np.int64) for v in (1, n, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            sizes = np.minimum(b, j - 1) - a + 1
            starts = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) + np.repeat(a - starts, sizes)
            own = np.repeat(j, sizes)
            costs = best[i] + x[own - 1] * (rows[own] - rows[i]) - (tokens[own] - tokens[i])
            least = np.minimum.reduceat(costs, starts)
            hits = np.flatnonzero(costs == np.repeat(least, sizes))
            first = i[hits[np.searchsorted(hits, starts)]]
            new[j], at[j] = least, first
            lo, hi, a, b = (np.concatenate(v) for v in ((lo, j + 1), (j - 1, hi), (a, first), (first, b)))
            some = lo <= hi
            lo, hi, a, b = lo[some], hi[some], a[some], b[some]
        cuts.append(at)
        best = new
    out, j = [], n
    for at in reversed(cuts):
        if j:
            out.append(int(x[j - 1]))
            j = int(at[j])
    if j:
        out.append(int(x[j - 1]))
    return sorted(set(out))


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """id, length, bucket (from 0), bucket_length, batch (from 0 in the bucket), slot (from 0 in the batch), padding.

    A bucket holds the lengths up to its boundary and above the one before; its batches hold max(1, budget div boundary)
    rows, in a seeded order, and only its last one fewer. A row longer than the budget is a batch of its own. Lengths of 0
    (null or blank texts) are packed too. Null ids are ids like any other; rows of one id are placed by length; equal rows
    are interchangeable. Other columns, whatever their names, are ignored. No documents: no rows.

    The histogram (rows by exact length) is global and combined before it is shuffled; only it reaches the driver. It has a
    row for each length that occurs, at most the square root of twice all tokens: 20,000 for the longest texts here.
    """
    sized = scratch.stage(docs.select(F.col(id_col).alias("id"), length.cast("long").alias("length")).withColumn("h", columns.order_key(seed, F.col("id"), F.col("length"))), "packing-lengths")
    found = sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    cuts = boundaries(np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64), buckets)
    table = F.array(*[F.lit(c).cast("long") for c in cuts or [0]])
    placed = sized.withColumn("bucket", F.aggregate(table, F.lit(0), lambda n, c: n + F.when(c < F.col("length"), 1).otherwise(0)))
    rows = prefix.running(placed, "bucket", ["h", "id", "length"], "length", prefix.pieces(sum(r[1] for r in found)))
    edge = F.element_at(table, F.col("bucket") + 1)
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(edge, F.lit(1))).cast("long"))
    return rows.select(F.col("id").alias(id_col), "length", "bucket", edge.alias("bucket_length"), F.floor(F.col("seq") / fits).cast("long").alias("batch"), (F.col("seq") % fits).cast("int").alias("slot"), (edge - F.col("length")).alias("padding"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by their words, 12 buckets, batches of 65,536 words with padding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, columns.n_words(F.col("text")))


def _sql() -> str:
    """The programme over all pairs of lengths, a table for each further bucket (i packed behind the cost), and the way back."""
    best, back = ["b1 as materialized (select j, x * r - t as cost, 0 as i from g union all select 0, 0, 0)"], [f"w{BUCKETS} as (select max(j) as j from g)"]
    for k in range(2, BUCKETS + 1):
        best.append(f"m{k} as materialized (select g.j, min((b.cost + g.x * (g.r - coalesce(p.r, 0)) - (g.t - coalesce(p.t, 0)))::hugeint * 16777216 + b.j) as m from g join b{k - 1} b on b.j < g.j left join g p on p.j = b.j group by g.j), b{k} as materialized (select j, (m // 16777216)::bigint as cost, (m % 16777216)::bigint as i from m{k} union all select 0, 0, 0)")
    for k in range(BUCKETS, 1, -1):
        back.append(f"w{k - 1} as (select i as j from b{k} where j = (select j from w{k}))")
    cuts = " union ".join(f"select x from g where j = (select j from w{k})" for k in range(1, BUCKETS + 1))
    return f"""
with d as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as length from documents),
f as (select length as x, count(*) as n from d group by 1),
g as materialized (select row_number() over (order by x) as j, x, (sum(n) over (order by x))::bigint as r, (sum(n * x) over (order by x))::bigint as t from f),
{", ".join(best)}, {", ".join(back)},
edges as (select x, lag(x, 1, -1) over (order by x) as low, (row_number() over (order by x) - 1)::int as bucket from ({cuts})),
p as (select doc_id, length, x as edge, bucket from d join edges on length > low and length <= x),
q as (select *, greatest(1, {BUDGET} // greatest(edge, 1)) as fits, row_number() over (partition by bucket order by {columns.order_key_sql(SEED, "doc_id", "length")}, doc_id) - 1 as seq from p)
select doc_id, length, bucket, edge as bucket_length, seq // fits as batch, (seq % fits)::int as slot, edge - length as padding from q
"""


ORACLE = _sql()
