"""Answers: from a question's sub-questions or mentions to ranked evidence, checked statuses, sources and a trace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions import vectors
from factloom.operators import graph, retrieval, verify
from factloom.sources import store

RELATED, FEW, WIDE = 40, 8, 16  # fixed values: related names, and facts of an answer over mentions and over vectors


@dataclass
class Graph:
    """facts, edges and entities; fact_vectors and entity_vectors (id, embedding) where the graph has them."""

    facts: DataFrame
    edges: DataFrame
    entities: DataFrame
    fact_vectors: DataFrame | None = None
    entity_vectors: DataFrame | None = None


def width(k: int, asked: int) -> int:
    """Facts that each of `asked` sub-questions fetches."""
    return max(12, k // max(1, asked) + 8)


def mentions(question: Column, found: Column) -> Column:
    """array<struct<mention,type>>: what a model found in a question; the whole question, of any type, where it found nothing."""
    none = F.array(F.struct(question.alias("mention"), F.lit(None).cast("string").alias("type")))
    return F.when(F.size(F.coalesce(found, F.array().cast("array<struct<mention:string,type:string>>"))) > 0, found).otherwise(none)


def tops(subs: list[list[float]], rows: DataFrame, k: int) -> DataFrame:
    """(list, id, score, pos): the k vectors (id, embedding) nearest to each sub-question's, in one scan. A row's vector is scaled
    once; the window keeps k rows a task before it shuffles. At most six sub-questions come from one question."""
    unit = [F.array(*[F.lit(x / (sum(y * y for y in q) ** 0.5 or 1.0)) for x in map(float, q)]) for q in subs]
    scores = vectors.bind(vectors.unit(F.col("embedding")), lambda v: F.array(*[F.round(vectors.dot(v, q), 6) for q in unit]))
    each = rows.select("id", F.posexplode(scores).alias("list", "score"))
    r = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))
    return each.withColumn("r", r).where(F.col("r") <= k).select("list", "id", "score", (F.col("r") - 1).alias("pos"))


def by_vectors(g: Graph, subs: list[list[float]], k: int = WIDE) -> DataFrame:
    """(id, pos): facts of an answer to sub-questions (their vectors).

    Each sub-question's nearest facts, less what is far below its best, and the facts that PageRank reaches from its five
    nearest entities over edges and key bridges take turns; facts with a number and facts without one alternate.
    """
    n = len(subs)
    near = retrieval.relevance_cut(tops(subs, g.fact_vectors, width(k, n)), "list").select("list", "id", (F.col("rank") - 1).alias("pos"))
    seeds = tops(subs, g.entity_vectors, 5).select(F.col("id").alias("node")).distinct()
    links = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(graph.key_bridges(g.entities).select("s", "t"))
    reached = retrieval.pagerank(links, seeds, wanted=g.facts.select(F.col("uuid").alias("node")), top=max(k, 25))
    walk = reached.select(F.col("node").alias("id"), F.round("score", 7).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(max(k, 25))
    walk = walk.select(F.lit(n).alias("list"), "id", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("pos"))
    order = retrieval.round_robin(near.unionByName(walk))  # a few hundred rows at most
    quantified = g.facts.select(F.col("uuid").alias("id"), F.col("q_value").isNotNull().alias("quantified")).join(F.broadcast(order), "id")
    return retrieval.first(retrieval.interleave(quantified), n, k)


def by_mentions(g: Graph, asked: DataFrame, question: list[float] | None = None, k: int = FEW) -> DataFrame:
    """(id, pos): facts of an answer by their participants among the entities that mentions (mention, type) link to, then by fused
    rank: the tagged facts, the question's nearest ones and those that PageRank reaches from the linked entities."""
    linked = graph.link_mentions(asked, g.entities).select("entity").distinct()
    ends = g.edges.where(~F.col("type").isin(vocab.NON_PARTICIPANT)).select(F.col("src").alias("fact"), F.col("dst").alias("entity"))
    # an edge's ends are looked up by their hashes, which PageRank takes; names come back for the facts that are counted
    both = retrieval.hashes(ends.select(F.col("fact").alias("a"), F.col("entity").alias("b")))
    both = store.cut(both.join(g.facts.select(F.xxhash64("uuid").alias("ha")), "ha", "left_semi").join(g.entities.select(F.xxhash64("uuid").alias("hb")), "hb", "left_semi"))
    over = both.join(linked.select(F.xxhash64("entity").alias("hb")), "hb", "left_semi").groupBy("ha").agg(F.countDistinct("hb").alias("overlap"))
    over = store.cut(g.facts.select(F.col("uuid").alias("fact")).join(over, F.xxhash64("fact") == F.col("ha")).select("fact", "overlap"))
    reached = retrieval.pagerank(both, linked.select(F.col("entity").alias("node")), wanted=g.facts.select(F.col("uuid").alias("node")), top=vocab.VECTOR_TOP)
    reached = reached.select(F.col("node").alias("id"), F.round("score", 7).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(vocab.VECTOR_TOP)
    lists = reached.select(F.lit(1).alias("list"), "id", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("pos"))
    if question is not None and g.fact_vectors is not None:
        lists = lists.unionByName(tops([question], g.fact_vectors, vocab.VECTOR_TOP).select(F.lit(0).alias("list"), "id", "pos"))
    best = retrieval.rank_tagged(over, lists, k)
    return best.select("id", (F.row_number().over(Window.orderBy(F.desc("overlap"), F.desc(F.round("rrf", 6)), "id")) - 1).alias("pos"))


def members_of(g: Graph, ranked: DataFrame) -> DataFrame:
    """(fact, entity, type, name) of an answer's facts alone: their edges are fetched first."""
    few = g.edges.join(F.broadcast(ranked.select(F.col("id").alias("src"))), "src", "left_semi")  # as many facts as an answer has
    return graph.participants(few, g.entities)


def retrieve(g: Graph, subs: list[list[float]] | None = None, asked: DataFrame | None = None, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """evidence (see `retrieval.evidence`) and related (name, pos): over vectors where the graph has them and no mentions are
    given, else over mentions."""
    if asked is None and subs and g.fact_vectors is not None and g.entity_vectors is not None:
        ranked = by_vectors(g, subs, k or WIDE)
    else:
        ranked = by_mentions(g, asked, (subs or [None])[0], k or FEW)
    ranked = store.cut(ranked)
    members = members_of(g, ranked)
    return retrieval.evidence(g.facts, members, ranked), retrieval.related(members, ranked, RELATED)


@dataclass
class Answer:
    """evidence with checked statuses, related names, sources, the trace's nodes and edges, and what the check asked and found."""

    evidence: DataFrame
    related: DataFrame
    sources: DataFrame
    nodes: DataFrame
    edges: DataFrame
    requests: DataFrame
    checked: DataFrame


def answer(g: Graph, subs: list[list[float]] | None = None, asked: DataFrame | None = None, verdicts: DataFrame | None = None, passages: DataFrame | None = None, papers: DataFrame | None = None, k: int = WIDE) -> Answer:
    """Evidence of a question; verdicts (uuid, confidence, clarity, relevance, rationale) on facts that none was asked for before set
    their status in the answer, and `verify.apply` writes `checked` back. Reading writes nothing."""
    found, names = retrieve(g, subs, asked, k)
    found = store.cut(found)
    none = g.facts.select("uuid", F.col("statement").alias("source")).where("false")
    texts = papers if papers is not None else g.facts.select("paper_ref", F.lit(None).cast("string").alias("text")).where("false")
    requests = verify.requests(g.facts, found, passages if passages is not None else none, texts)
    checked = verify.settle(requests, verdicts if verdicts is not None else g.facts.select("uuid", *[F.lit(None).cast("double").alias(c) for c in ("confidence", "clarity", "relevance")], F.lit("").alias("rationale")).where("false"))
    told = found.join(checked.select("uuid", F.col("status").alias("_s")), "uuid", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    nodes, edges = graph.trace(told)
    return Answer(told, names, retrieval.sources(told.where("source <> ''").select(F.col("source").alias("paper_ref"), "pos")), nodes, edges, requests, checked)


def prompt_rows(evidence: DataFrame) -> DataFrame:
    """(pos, line): an answer's evidence as JSON, a line a fact, for the model that words it."""
    own = F.struct("statement", F.col("quantity").alias("value"), "participants", "source", "year", "status")
    return evidence.select("pos", F.to_json(own, {"ignoreNullFields": "false"}).alias("line"))

