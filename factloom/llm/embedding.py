"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside a cell, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm.components import components

THRESHOLD = 0.93  # also named in ORACLE
#: Vectors that a cell should hold at most, and at least; an eighth of a label's in between. Rows of a block; vectors that k-means
#: learns from in all; cells in all.
CELL, LEAST_CELL, BLOCK, SAMPLE, MOST_CELLS = 2048, 16, 2048, 20_000, 1024


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very small or large components are lost
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids of unit rows; the starts are rows evenly spaced, an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(k):
            s = x[own == j].sum(axis=0)
            if (n := np.sqrt(s @ s)) > 1e-12:
                c[j] = s / n
    return c


def cells(x: np.ndarray, c: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(cell, rows, home): the cell of the nearest centroid, and the later cells where a row can have a partner.

    A partner y of x with cosine >= threshold lies within r = sqrt(2 - 2 threshold) of it. If y's cell is d and x's is c, then
    y . (d - c) >= 0, so x . (d - c) >= -r |d - c|. Rows go to each later cell d for which this holds: no link is lost.
    """
    dots = x @ c.T
    home = dots.argmax(axis=1)
    r = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    for d in range(len(c)):
        yield d, np.flatnonzero(home == d), True
        reach = np.sqrt(((c[d] - c) ** 2).sum(axis=1))[home]
        yield d, np.flatnonzero((home < d) & (dots[:, d] - dots[np.arange(len(x)), home] >= -r * reach)), False


def _stars(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    root, left = np.arange(len(hit)), hit.any(axis=1)
    while left.any():
        first = int(left.argmax())
        front = np.zeros(len(hit), bool)
        front[first] = True
        left[first] = False
        while front.any():
            root[front] = first
            front = hit[front].any(axis=0) & left
            left &= ~front
    return root


def link(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root): for each task and class with a partner in it, the partners' copies, and a class joined to it.

    classes: id, label (text), v (array), n (copies). k-means is fitted for each label on a bounded sample, in the order of a
    hash, whatever the label's size; of more labels than half of MOST_CELLS the smaller ones are one cell each. Home and
    visiting rows of a cell are cut into blocks of BLOCK by hash, and two blocks meet in one task as one product of matrices.
    The cells set the cost: every partner is found whatever they are.
    """
    spark = classes.sparkSession
    sizes = classes.groupBy("label").count().where(F.col("count") > 2 * LEAST_CELL).orderBy(F.desc("count"), "label").limit(MOST_CELLS // 2).collect()
    total = sum(r["count"] for r in sizes)
    centroids: dict[str, np.ndarray] = {}
    if sizes:
        share = min(1.0, SAMPLE / total)
        picked = classes.where(F.col("label").isin([r["label"] for r in sizes]) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).select("label", "id", "v").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE + SAMPLE // 4).collect()
        for r in sizes:
            rows = [p["v"] for p in picked if p["label"] == r["label"]]
            cell = min(CELL, max(LEAST_CELL, r["count"] // 8))
            k = max(1, min(-(-r["count"] // cell), MOST_CELLS * r["count"] // (2 * total) + 1, len(rows) // 8))
            if k > 1 and len({len(v) for v in rows}) == 1:
                centroids[r["label"]] = spherical_kmeans(unit(np.array(rows)), k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = np.array(b.column(1).to_pylist(), object)
            size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            for one in sorted(set(label)):
                for dim in np.unique(size[label == one]):
                    own = np.flatnonzero((label == one) & (size == dim))
                    c = centroids.get(one)
                    if c is None or c.shape[1] != dim:
                        found = [(0, np.arange(len(own)), True)]
                    else:
                        found = cells(unit(np.stack(b.column(2).take(pa.array(own)).to_numpy(zero_copy_only=False))), c, threshold)
                    for cell, rows, home in found:
                        if len(rows):
                            part = b.take(pa.array(own[rows]))
                            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), cell, np.int32)), pa.array(np.full(len(rows), home))], ["id", "label", "v", "n", "dim", "cell", "home"])

    routed = scratch.stage(classes.select("id", "label", "v", "n").mapInArrow(route, f"id long, label string, v {classes.schema['v'].dataType.simpleString()}, n long, dim int, cell int, home boolean"), "embedding-cells")
    key = ["label", "dim", "cell"]
    counts = routed.groupBy(*key).agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(n) for n, c in (("homes", F.col("home")), ("visits", ~F.col("home")))])
    dealt = routed.join(scratch.small(counts, "embedding-counts"), key)
    b = F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(F.lit(1), F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits")))).cast("int")
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    tasks = F.when(F.col("home"), F.concat(F.transform(to(F.col("homes")), lambda o: pair(F.least(F.col("b"), o), F.greatest(F.col("b"), o))), F.transform(to(F.col("visits")), lambda o: pair(F.col("b"), F.col("homes") + o)))).otherwise(F.transform(to(F.col("homes")), lambda o: pair(o, F.col("homes") + F.col("b"))))
    dealt = dealt.withColumn("b", b).withColumn("own", F.when(F.col("home"), F.col("b")).otherwise(F.col("homes") + F.col("b"))).withColumn("t", F.explode(tasks)).select(*key, "t.i", "t.j", "own", "id", "v", "n")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        x = unit(np.stack(table.column("v").to_numpy()))
        first = table.column("own").to_numpy() == table.column("i")[0].as_py()
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        if table.column("i")[0] != table.column("j")[0]:
            hit &= first[:, None] != first[None, :]
        linked = np.flatnonzero(hit.any(axis=1))
        return pa.table({"id": ids[linked], "links": hit[linked].astype(np.int64) @ n, "root": ids[_stars(hit)[linked]]})

    return dealt.groupBy(*key, "i", "j").applyInArrow(compare, "id long, links long, root long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of rows (vec_id, embedding, label).

    Only vectors with equal, non-null labels (of any type that has a text) and as many components are compared, in double
    precision; components wider than a float stay as they are. Vectors that are null, zero, empty, or hold null or non-finite
    components link with nothing, nor does a row with a null vec_id: no links, component null, kept. Equal vectors of a
    label become one class first; its copies count as links of each other and are never expanded. Rows that repeat count as
    further vectors. Extra columns are ignored; an empty table gives no row.
    """
    narrow = rows.schema["embedding"].dataType.elementType.simpleString() in ("float", "tinyint", "smallint")
    v = F.col("embedding")
    good = v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.cast("array<float>" if narrow else "array<double>").alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    classes = scratch.stage(d.where("good").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "embedding-classes")
    found = scratch.stage(link(classes, threshold), "embedding-links")
    joined = components(found.select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "cid")
    links = found.groupBy(F.col("id").alias("lid")).agg(F.sum("links").alias("links"))
    told = classes.join(links, F.col("id") == F.col("lid"), "left").join(joined, F.col("id") == F.col("cid"), "left")
    told = told.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = d.join(told, F.col("good") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
with recursive good as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as materialized (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
n as (select a, count(*) as n_links from pairs group by a), c as (select a, min(b) as low from reach group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id <= coalesce(low, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
