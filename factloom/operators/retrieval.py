"""Ranking and retrieval: overlap, vector top-k, rank fusion, relevance cut, diversification, personalised PageRank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions import ids, text, vectors
from factloom.sources import store


def overlap(members: DataFrame, anchors: DataFrame) -> DataFrame:
    """(fact, overlap): anchors (entity) among a fact's participants."""
    return members.join(anchors.select("entity").distinct(), "entity", "left_semi").groupBy("fact").agg(F.countDistinct("entity").alias("overlap"))


def vector_top(query_vector: list[float], df: DataFrame, k: int = vocab.VECTOR_TOP) -> DataFrame:
    """The k vectors (id, embedding) nearest to a query vector, with pos from 0: a top-k in each task, then one of k rows a task."""
    n = math.sqrt(sum(float(x) ** 2 for x in query_vector)) or 1.0
    q = F.array(*[F.lit(float(x) / n) for x in query_vector])  # of length 1: one dot and one norm a row
    top = df.withColumn("score", F.round(vectors.dot(F.col("embedding"), q) / vectors.norm(F.col("embedding")), 6)).orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", "score", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("pos"))


def anchors(by_name: DataFrame, by_vector: DataFrame) -> DataFrame:
    """(entity): entities linked by name or by vector, once each."""
    return by_name.select("entity").union(by_vector.select("entity")).distinct()


def seeds(lists: DataFrame, k: int = 5) -> DataFrame:
    """(id): the first k of each list (list, id, pos), once each."""
    return lists.where(F.col("pos") < k).select("id").distinct()


def first(ordered: DataFrame, asked: int, k: int = 8) -> DataFrame:
    """The first rows (pos) of an answer: k, or four a sub-question if that is more."""
    return ordered.where(F.col("pos") < max(k, 4 * asked))


def fuse(ranked: DataFrame, c: int = vocab.RRF_C) -> DataFrame:
    """(id, rrf): the sum of 1 / (c + pos) over lists (list, id, pos from 0)."""
    return ranked.groupBy("id").agg(F.sum(1.0 / (F.lit(c) + F.col("pos"))).alias("rrf"))


def relevance_cut(scored: DataFrame, by: str = "sub", share: float = vocab.KEEP_SHARE, least: int = vocab.KEEP_LEAST) -> DataFrame:
    """Of each list, rows with `share` of its best score, or, if they are fewer, its first `least`."""
    best = F.max("score").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return scored.withColumn("best", best).withColumn("rank", rank).where((F.col("score") >= share * F.col("best")) | (F.col("rank") <= least)).drop("best")


def round_robin(ranked: DataFrame) -> DataFrame:
    """(id, pos): the lists (list, id, pos) taken in turn, each id where it first appears."""
    first = ranked.groupBy("id").agg(F.min(F.struct("pos", "list")).alias("at"))
    return first.select("id", (F.row_number().over(Window.orderBy("at.pos", "at.list", "id")) - 1).alias("pos"))


def interleave(ordered: DataFrame) -> DataFrame:
    """(id, pos): rows with a number and rows without (quantified boolean) in turn, each class in its order, numbers first."""
    n = F.row_number().over(Window.partitionBy("quantified").orderBy("pos"))
    return ordered.withColumn("n", n).select("id", (F.row_number().over(Window.orderBy("n", F.desc("quantified"))) - 1).alias("pos"))


def rank(rrf: DataFrame, overlaps: DataFrame, k: int) -> DataFrame:
    """The first k ids by overlap, then fused score, then id; candidates are in either input."""
    both = rrf.join(overlaps.select(F.col("fact").alias("id"), "overlap"), "id", "full_outer").fillna(0, ["overlap"]).fillna(0.0, ["rrf"])
    return both.orderBy(F.desc("overlap"), F.desc(F.round("rrf", 6)), "id").limit(k)


def rank_tagged(overlaps: DataFrame, lists: DataFrame, k: int = 8) -> DataFrame:
    """(id, overlap, rrf): the first k by overlap, fused score and id, where all facts with an overlap (fact, overlap) are themselves a
    ranked list beside the short lists (list, id, pos).

    A fact outside the short lists and behind k others in the tagged one is behind them in the answer too. So only the first k
    of that list and the short lists' facts get their place in it: the latter by counting who is ahead, in one pass.
    """
    tagged = overlaps.where("overlap > 0").select(F.col("fact").alias("id"), "overlap")
    few = lists.select("id").distinct()  # as many as the short lists hold
    top = tagged.orderBy(F.desc("overlap"), "id").limit(k)
    ask = F.broadcast(tagged.join(few, "id", "left_semi").select(F.col("id").alias("q"), F.col("overlap").alias("qo")))
    ahead = tagged.join(ask, (F.col("overlap") > F.col("qo")) | ((F.col("overlap") == F.col("qo")) & (F.col("id") < F.col("q")))).groupBy("q").agg(F.count(F.lit(1)).alias("pos"))
    placed = tagged.join(few, "id", "left_semi").join(ahead, F.col("id") == F.col("q"), "left").select("id", F.coalesce("pos", F.lit(0)).alias("pos"))
    first = top.select("id", (F.row_number().over(Window.orderBy(F.desc("overlap"), "id")) - 1).cast("long").alias("pos"))
    own = placed.union(first).distinct().select(F.lit(-1).alias("list"), "id", "pos")
    fused = fuse(own.unionByName(lists.select(F.col("list").cast("int").alias("list"), "id", F.col("pos").cast("long").alias("pos"))))
    return rank(fused, tagged.join(fused.select("id"), "id", "left_semi").select(F.col("id").alias("fact"), "overlap"), k)


#: Edges up to which one task holds a graph as numbers: 16 bytes each for both ends in both directions, and some rounds' scores.
KERNEL = 4_000_000
#: Nodes that each task of a larger graph's rounds may hold scores of: 8 bytes each, three times over.
CORE = 16_000_000
#: Edges of a part, and numbers of a slice, that travel at once.
PART, SLICE = 2_000_000, 1 << 18


def hashes(edges: DataFrame) -> DataFrame:
    """(ha, hb): the ends of edges (a, b) as 64-bit hashes; no loops, no nulls. pagerank takes these in place of names."""
    return edges.where("a <> b and a is not null and b is not null").select(F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, damping: float = 0.85, kernel: int = KERNEL, wanted: DataFrame | None = None, core: int = CORE, top: int | None = None) -> DataFrame:
    """(node, score): personalised PageRank over undirected distinct edges (a, b) from seeds (node), all mass starting there; of the
    wanted nodes (node) only, if given. With `top` only wanted nodes whose score to 7 digits is not below the top-th one's are
    named, all equal ones among them. Edges may come as `hashes` that were written, with wanted nodes.

    A seed without edges gives its mass back to the seeds, so the scores sum to 1. Nodes that no mass reaches have no row;
    without seeds there is none. A graph of `kernel` edges at most is worked through in one task, whose size so is
    bounded. A larger one with `core` different ends on one side at most is cut by the nodes of the other side, and only the scores
    of that side travel each round; any other round by round over edges that stay partitioned by their start. Nodes are
    64-bit hashes until their names are looked up: of 200 million nodes two share one with a probability of 1e-3.
    """
    start = store.cut(seeds.where("node is not null").select("node").distinct())
    hashed = edges if "ha" in edges.columns else store.cut(hashes(edges))
    seed, n = start.select(F.xxhash64("node").alias("h")), hashed.count()
    ask = None if wanted is None else wanted.select("node")
    if n <= kernel:
        scores = _in_one_task(hashed, seed, rounds, damping)
    else:
        ends = hashed.agg(F.approx_count_distinct("ha").alias("ha"), F.approx_count_distinct("hb").alias("hb")).first()
        side, other = ("ha", "hb") if ends["ha"] < ends["hb"] else ("hb", "ha")
        hubs = hashed.groupBy(side).agg(F.count(F.lit(1))).select(F.col(side).alias("h"))
        known = np.sort(hubs.toArrow().column(0).to_numpy()) if ends[side] <= core * 0.9 else None  # `core` numbers at most
        if known is None or len(known) > core:
            scores = _by_rounds(hashed.select(F.col("ha").alias("a"), F.col("hb").alias("b")), seed, rounds, damping)
        else:
            scores = _over_core(hashed.select(F.col(other).alias("r"), F.col(side).alias("c")), seed, known, n, rounds, damping, ask)
    if ask is None:
        names = edges.where("a <> b").select(F.col("a").alias("node")).union(edges.where("a <> b").select("b")).where("node is not null").union(start).distinct()
        return names.join(scores, F.xxhash64("node") == F.col("h")).select("node", "score")
    if top is None:
        return ask.join(scores, F.xxhash64("node") == F.col("h")).select("node", "score")
    scores, digits, k = store.cut(scores), F.round("score", 7), max(64, 2 * top)
    while True:  # nodes that are not wanted may be among the first; then more of them are looked at
        least = scores.orderBy(F.desc("score")).limit(k).agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).first()
        if least["n"] < k:
            return ask.join(scores, F.xxhash64("node") == F.col("h")).select("node", "score")
        few = scores.where(digits >= round(least["s"], 7))
        few = F.broadcast(few) if few.count() <= 100_000 else few
        found = store.cut(ask.join(few, F.xxhash64("node") == F.col("h")).select("node", "score"))
        if found.count() >= top:
            return found
        k *= 16


def _backs(alone: float, rounds: int, damping: float) -> list[float]:
    """What all seeds get in each round: the teleported part, and what those without edges, a part `alone` of them, had of it before."""
    back = [1.0]
    for _ in range(rounds):
        back.append((1 - damping) + damping * alone * back[-1])
    return back


def _in_one_task(hashed: DataFrame, start: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(h, score) over edges (ha, hb) from seeds (h)."""
    rows = hashed.select("ha", "hb").union(start.select("h", F.lit(None).cast("long")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy(), b.column(1).is_null().to_numpy(zero_copy_only=False)) for b in batches]
        if not parts:
            return
        one, two, seed = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.concatenate([one, two[~seed]]), return_inverse=True)
        seeds, u, v = at[: len(one)][seed], at[: len(one)][~seed], at[len(one) :]
        both = np.unique(np.concatenate([u * len(nodes) + v, v * len(nodes) + u]))
        a, b = both // len(nodes), both % len(nodes)
        if not len(seeds):
            return
        degree = np.bincount(a, minlength=len(nodes))
        share = np.zeros(len(nodes))
        share[seeds] = 1 / len(seeds)
        score = share
        for x in _backs(float((degree[seeds] == 0).mean()), rounds, damping)[1:]:
            score = damping * np.bincount(b, weights=(score / np.maximum(1, degree))[a], minlength=len(nodes)) + x * share
        some = np.flatnonzero(score)
        for i in range(0, len(some), 65_536):
            own = some[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(score[own])], ["h", "score"])

    return rows.repartition(1).mapInArrow(walk, "h long, score double")


def _over_core(edges: DataFrame, seed: DataFrame, known: np.ndarray, n: int, rounds: int, damping: float, wanted: DataFrame | None) -> DataFrame:
    """(h, score) over edges (r, c) whose ends c are all in the core, `known`, sorted; of the core's nodes only the wanted, if given.

    Each other node lies in one part with all its edges, as numbers of the core's nodes. What it gives in a round follows from
    the core's scores two rounds before, so a task adds up what its parts give to the core, and nothing else is shuffled.
    Edges between two nodes of the core (m = 1) are dealt by both ends.
    """
    spark = edges.sparkSession
    sc = spark.sparkContext
    parts, size = max(sc.defaultParallelism, -(-n // PART)), len(known)
    core = sc.broadcast(known)

    def place(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(core.value, h), size - 1)
        return at.astype(np.int32), core.value[at] == h

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, c = b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy()
            mark = b.column(1).is_null().to_numpy(zero_copy_only=False)  # a seed
            (at, inside), (to, _) = place(r), place(c)
            to[mark] = -1
            both = inside & ~mark
            low, high = np.minimum(at, to), np.maximum(at, to)
            keep = ~(inside & mark)  # seeds in the core are known below
            key = np.where(both, low, r)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(np.where(both, high, to)[keep].astype(np.int32)), pa.array(both[keep])], ["r", "c", "m"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if not got:
            return
        r, c, m = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((c, r, m))
        r, c, m = r[order], c[order], m[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1]) | (m[1:] != m[:-1])
        r, c, m = r[new], c[new], m[new]
        i, j = r[m].astype(np.int32), c[m]
        r, c = r[~m], c[~m]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(r)), bool), r[1:] != r[:-1]]))
        seeds = c[first] == -1
        count = np.diff(np.append(first, len(r))).astype(np.int32) - seeds
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (r[first], count, seeds, c[c >= 0], i, j)], ["h", "n", "seed", "c", "i", "j"])

    rows = edges.select("r", "c").union(seed.select("h", F.lit(None).cast("long")))
    dealt = rows.mapInArrow(number, "r long, c int, m boolean").repartition(parts, "r", F.when(F.col("m"), F.col("c")))
    own = store.cut(dealt.mapInArrow(gather, "h binary, n binary, seed binary, c binary, i binary, j binary"))
    tasks = max(1, sc.defaultParallelism)

    def read(b: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        kinds = {"h": np.int64, "n": np.int32, "seed": bool, "c": np.int32, "i": np.int32, "j": np.int32}
        for x in b.to_pylist():
            yield {k: np.frombuffer(v, kinds[k]) for k, v in x.items()}

    def total(run, columns: list[str], length: int) -> np.ndarray:
        """The sum of the vectors that tasks make of their parts."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros(length)
            for b in batches:
                for x in read(b):
                    run(x, y)
            for k in range(0, length, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([y[k : k + SLICE].tobytes()])], ["k", "y"])

        def add(table: pa.Table) -> pa.Table:
            y = sum(np.frombuffer(v.as_py()) for v in table.column("y"))
            return pa.table({"k": table.column("k")[:1], "y": pa.array([y.tobytes()])})

        made = own.select(*columns).coalesce(tasks).mapInArrow(one, "k long, y binary").groupBy("k").applyInArrow(add, "k long, y binary").toArrow().sort_by("k")
        return np.concatenate([np.frombuffer(v.as_py()) for v in made.column("y")]) if len(made) else np.zeros(length)

    def count(x: dict[str, np.ndarray], y: np.ndarray) -> None:
        y[:size] += np.bincount(x["c"], minlength=size) + np.bincount(x["i"], minlength=size) + np.bincount(x["j"], minlength=size)
        y[size] += (x["seed"] & (x["n"] == 0)).sum()

    told = total(count, ["n", "seed", "c", "i", "j"], size + 1)
    degree, alone = np.maximum(told[:size], 1), told[size]
    asked = seed.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array(at[ok])], ["at"]) for b in bs for at, ok in [place(b.column(0).to_numpy())]), "at int").toArrow().column(0).to_numpy()
    share = seed.count()
    if not share:
        return seed.select("h", F.lit(0.0).alias("score")).where("false")
    back = [x / share for x in _backs(alone / share, rounds, damping)]
    start = np.zeros(size)
    start[asked] = 1.0

    def held(x: dict[str, np.ndarray], given: np.ndarray | None, x_k: float) -> np.ndarray:
        """The scores of a part's own nodes, from what the core gave."""
        score = x["seed"] * x_k
        if given is not None and len(x["c"]):
            some = np.flatnonzero(x["n"])
            score[some] += damping * np.add.reduceat(given[x["c"]], np.cumsum(x["n"][some]) - x["n"][some])
        return score

    def step(before, now, x_k: float):
        def run(x: dict[str, np.ndarray], y: np.ndarray) -> None:
            score = held(x, None if before is None else before.value, x_k)
            if len(x["c"]):
                y += np.bincount(x["c"], np.repeat(score / np.maximum(1, x["n"]), x["n"]), size)
            if len(x["i"]):
                y += np.bincount(x["i"], now.value[x["j"]], size) + np.bincount(x["j"], now.value[x["i"]], size)

        return run

    score, before = back[0] * start, None
    now = sc.broadcast(score / degree)
    for k in range(rounds):
        score = damping * total(step(before, now, back[k]), ["n", "seed", "c", "i", "j"], size) + back[k + 1] * start
        if before is not None:
            before.destroy()
        before, now = now, sc.broadcast(score / degree)
    last = sc.broadcast(score)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in read(b):
                own = held(x, before.value if before is not None else None, back[rounds])
                some = own > 0
                yield pa.RecordBatch.from_arrays([pa.array(x["h"][some]), pa.array(own[some])], ["h", "score"])

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ok = place(b.column(0).to_numpy())
            ok &= last.value[at] > 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(last.value[at[ok]])], ["h", "score"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_numpy():
                h, s = core.value[k : k + SLICE], last.value[k : k + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array(h[s > 0]), pa.array(s[s > 0])], ["h", "score"])

    schema = "h long, score double"
    middle = spark.range(0, size, SLICE).mapInArrow(every, schema) if wanted is None else wanted.where("node is not null").select(F.xxhash64("node").alias("h")).mapInArrow(centre, schema).distinct()
    return own.select("h", "n", "seed", "c").mapInArrow(ends, schema).union(middle)


def _by_rounds(pairs: DataFrame, start: DataFrame, rounds: int, damping: float, every: int = 5) -> DataFrame:
    """(h, score): edges (a, b) are kept, partitioned by their start, for all rounds."""
    n = start.count()
    both = store.cut(pairs.union(pairs.select("b", "a")).distinct())
    alone = start.join(both.select(F.col("a").alias("h")), "h", "left_anti").count() / max(1, n)
    back = [x / max(1, n) for x in _backs(alone, rounds, damping)]
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = store.cut(both.join(degree, "a").select(F.col("a").alias("s"), F.col("b").alias("t"), "degree")).repartition(parts, "s").persist(StorageLevel.DISK_ONLY)
    score = start.select("h", F.lit(back[0]).alias("score"))
    for k, x in enumerate(back[1:], 1):
        flow = score.join(e, F.col("h") == F.col("s")).select(F.col("t").alias("h"), (damping * F.col("score") / F.col("degree")).alias("score"))
        score = flow.union(start.select("h", F.lit(x).alias("score"))).groupBy("h").agg(F.sum("score").alias("score"))
        score = store.cut(score) if k % every == 0 or k == rounds else score
    e.unpersist()
    return score


def sources(evidence: DataFrame) -> DataFrame:
    """(paper_ref, n): papers of the evidence (paper_ref, pos) by count, then by first appearance."""
    g = evidence.groupBy("paper_ref").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return g.orderBy(F.desc("n"), "first")


def evidence(facts: DataFrame, members: DataFrame, ranked: DataFrame) -> DataFrame:
    """(pos, uuid, statement, quantity, participants, source, year, status) of an answer's facts, ranked (id, pos)."""
    from factloom.operators import graph

    few = ranked.select(ids.digest("id").alias("_f"), "pos")
    own = graph.keyed(members).join(few.select("_f"), "_f", "left_semi")
    told = graph.fact_detail(graph.keyed(facts, "uuid").withColumn("uuid", ids.pack("uuid")).join(few, "_f").withColumn("uuid", ids.unpack("uuid")), own)
    quantity = text.quantity(F.col("q_raw"), F.col("q_operator"), F.col("q_value"), F.col("q_unit"))
    return told.select("pos", "uuid", F.coalesce("statement", F.lit("")).alias("statement"), quantity.alias("quantity"), F.col("parts").alias("participants"), F.coalesce("paper_ref", F.lit("")).alias("source"), "year", F.coalesce("status", F.lit("")).alias("status"))


def related(members: DataFrame, ranked: DataFrame, most: int | None = None) -> DataFrame:
    """(name, pos): the different names of participants in an answer's facts, by where they first appear, the first `most`."""
    own = members.join(ranked.select(F.col("id").alias("fact"), F.col("pos").alias("at")), "fact")
    first = own.groupBy("name").agg(F.min(F.struct("at", "type")).alias("at"))
    first = first if most is None else first.orderBy("at.at", "at.type", "name").limit(most)
    return first.select("name", (F.row_number().over(Window.orderBy("at.at", "at.type", "name")) - 1).alias("pos"))


def decompose(answers: DataFrame, most: int = 6) -> DataFrame:
    """answers (question, subs array) with subs trimmed, blank ones gone, the first few kept; the question itself where none is left."""
    kept = F.filter(F.transform("subs", lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    few = F.slice(kept, 1, most)
    return answers.withColumn("subs", F.when(F.size(few) > 0, few).otherwise(F.array("question")))


def discover(feed: DataFrame, known: DataFrame, n: int = 6) -> DataFrame:
    """(pos, title, authors, year, venue, doi, url): the first n of a feed (pos, title, authors array<struct<given,family>>, year,
    venue, doi, url) that the corpus (title) does not have; three authors at most, blank ones left out. n is the feature."""
    from factloom.operators import graph

    say = lambda a: F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))))
    names = F.array_join(F.filter(F.transform(F.slice("authors", 1, 3), say), lambda s: s != ""), ", ")
    new = graph.discover_new(feed.where("title <> ''"), known)
    return new.orderBy("pos").limit(n).select("pos", "title", F.coalesce(names, F.lit("")).alias("authors"), "year", "venue", "doi", "url")
