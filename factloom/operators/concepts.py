"""The concept layer: candidates, groups of near entities, maturity, and a taxonomy without cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text, vectors
from factloom.operators import paths, similar
from factloom.sources import store

# fixed values
BLOCK, LINK_K, HIER_K, CONTEXT_CAP, DEFINE_AT, MERGE = 0.45, 6, 8, 360, 3, 0.92


def candidates(items: DataFrame, known: DataFrame, k: int = LINK_K, least: float = BLOCK) -> DataFrame:
    """(item, concept, score, pos): the k nearest concepts of the same type with a cosine of `least` or more.

    items and known: id, type, embedding. Blocks of both meet, each returns its best k + 1 of an item, and the window ranks those by
    their whole scores, ties by concept.
    """
    near = similar.join(items, known, least, top=k + 1, whole=True).where("a <> b").select(F.col("a").alias("item"), F.col("b").alias("concept"), "score")
    pos = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "concept")) - 1
    return near.withColumn("pos", pos).where(F.col("pos") < k)


def vectors_of(entities: DataFrame, contexts: DataFrame, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, type, embedding, context) of entities (uuid, type, canonical_name, aliases): the blend of what `embed` makes of an entity's
    text and of its context (entity, context); without one, of the text alone. embed(rows, column) adds `embedding`."""
    text_of = text.entity_text(F.col("canonical_name"), F.col("aliases"))
    own = entities.select(F.col("uuid").alias("id"), "type", text_of.alias("_text")).join(contexts.select(F.col("entity").alias("id"), "context"), "id", "left")
    own = own.withColumn("_said", F.coalesce(F.nullif(F.col("context"), F.lit("")), "_text"))
    named = embed(own, "_text").withColumnRenamed("embedding", "_name")
    both = embed(named, "_said").withColumnRenamed("embedding", "_context")
    return both.select("id", "type", vectors.blend(F.col("_name"), F.col("_context")).alias("embedding"), F.coalesce("context", F.lit("")).alias("context"))


def canopies(items: DataFrame, least: float = BLOCK, merge_at: float = MERGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """canopies (node, comp) of items (id, type, embedding) joined by cosines of `least`, the clusters (node, comp) of near-identical
    ones (`merge_at`) inside them, and the pairs (a, b, score) of `least` and more that both rest on."""
    near = store.cut(similar.pairs(items, least).select("a", "b", "score"))
    nodes = items.select(F.col("id").alias("node"))
    return components(nodes, near), components(nodes, near.where(F.col("score") >= merge_at)), near


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that pairs (a, b) connect to each node; a node without pairs is its own.

    Labels fall to the smallest neighbour's and then to the label of that label, so rounds grow with the logarithm of long chains.
    """
    both = store.cut(pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct())
    labels = store.cut(nodes.select("node", F.col("node").alias("comp")).distinct())
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").select(F.col("a").alias("node"), "comp")
        low = labels.union(near).groupBy("node").agg(F.min("comp").alias("comp"))
        jump = low.alias("l").join(low.select(F.col("node").alias("n"), F.col("comp").alias("c")), F.col("l.comp") == F.col("n"), "left")
        new = store.cut(jump.select("node", F.least("comp", F.coalesce("c", "comp")).alias("comp")))
        if new.join(labels, ["node", "comp"], "left_anti").isEmpty():
            return new
        labels = new


def match(cands: DataFrame, answers: DataFrame) -> DataFrame:
    """(item, concept) where the answer (item, pos) picks one of an item's candidates."""
    return cands.join(answers, ["item", "pos"]).select("item", "concept")


def found_concepts(entities: DataFrame, clusters: DataFrame, answers: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New concepts (concept, name, type) and instances (entity, concept) of entities (uuid, type, canonical_name) that matched none.

    clusters: (node, comp), near-identical entities. A cluster's smallest entity speaks for it, in the order of ids: an answer
    (item, concept) places it at the concept that an earlier speaker founded, if that one is among its candidates, near (a, b)
    where given; else it founds a concept, unless its name is a phrase or a list of values, and then the cluster has none.
    The others of the cluster follow without a call. An answer that names a speaker who founded nothing counts as none.
    Speakers wait for those that they name, so there are as many rounds as names in the longest chain.
    """
    own = entities.join(clusters, entities["uuid"] == clusters["node"]).select("uuid", "type", "canonical_name", "comp")
    head = own.where("uuid = comp").join(answers.select(F.col("item").alias("uuid"), F.col("concept").alias("told")), "uuid", "left").withColumn("told", F.when(F.col("told") < F.col("uuid"), F.col("told")))
    if near is not None:
        ok = near.select(F.greatest("a", "b").alias("uuid"), F.least("a", "b").alias("told")).distinct().withColumn("_near", F.lit(True))
        head = head.join(ok, ["uuid", "told"], "left").withColumn("told", F.when(F.col("_near"), F.col("told"))).drop("_near")
    names = text.conceptual(F.col("canonical_name"))
    state = store.cut(head.select("uuid", "told", names.alias("fit"), F.when(F.col("told").isNull(), names).alias("founds")))
    while not state.where("founds is null").isEmpty():
        settled = state.where("founds is not null").select(F.col("uuid").alias("told"), F.col("founds").alias("_f"))
        unknown = state.where("founds is null").select(F.col("uuid").alias("told")).withColumn("_open", F.lit(True))
        step = state.join(settled, "told", "left").join(unknown, "told", "left")
        founds = F.when(F.col("founds").isNotNull(), F.col("founds")).when(F.col("_open"), F.lit(None)).when(F.coalesce("_f", F.lit(False)), F.lit(False)).otherwise(F.col("fit"))
        told = F.when(F.col("founds").isNotNull() | F.col("_open") | F.coalesce("_f", F.lit(False)), F.col("told"))
        state = store.cut(step.select("uuid", told.alias("told"), "fit", founds.cast("boolean").alias("founds")))
    placed = state.where("founds or told is not null").select("uuid", F.when(F.col("founds"), F.col("uuid")).otherwise(F.col("told")).alias("concept"))
    new = own.join(state.where("founds").select("uuid"), "uuid", "left_semi").select(F.col("uuid").alias("concept"), F.col("canonical_name").alias("name"), "type")
    return new, own.join(placed.select(F.col("uuid").alias("comp"), "concept"), "comp").select(F.col("uuid").alias("entity"), "concept")


def maturity(instances: DataFrame) -> DataFrame:
    """(concept, n, context, mature) of instances (concept, seq, context).

    Contexts of the first instances up to the third are pooled in order, each once, up to the cap; three instances make it mature.
    """
    rank = F.row_number().over(Window.partitionBy("concept").orderBy("seq"))
    n = instances.groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    few = instances.withColumn("rank", rank).where(F.col("rank") <= DEFINE_AT).groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("context", F.lit("")).alias("c")))).alias("cs"))
    add = lambda a, x: F.when((x["c"] == "") | a.contains(x["c"]) | (F.char_length(a) >= CONTEXT_CAP), a).otherwise(F.substring(F.when(a == "", x["c"]).otherwise(F.concat(a, F.lit(" | "), x["c"])), 1, CONTEXT_CAP))
    return few.join(n, "concept").select("concept", "n", F.aggregate("cs", F.lit(""), add).alias("context"), (F.col("n") >= DEFINE_AT).alias("mature"))


def closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor): all pairs reachable over (child, parent); path lengths double each round, cycles end with no new pair."""
    return paths.closure(edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))).select(F.col("a").alias("child"), F.col("b").alias("ancestor"))


def _reached(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(start, node): what each of ends (start) reaches over edges (child, parent), from these ends only; a round a step."""
    seen = store.cut(ends.select("start").distinct().select("start", F.col("start").alias("node")))
    front = seen
    while True:
        nxt = front.join(edges.select(F.col("child").alias("node"), "parent"), "node").select("start", F.col("parent").alias("node")).distinct()
        front = store.cut(nxt.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def place(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (child, parent) edges that close no cycle, neither with edges that are there nor with each other.

    Only what the wanted edges' own ends reach is searched, never all pairs of the taxonomy. Wanted edges on a common cycle
    are decided one a round, the smallest first, in each set of nodes that reach one another; all others at once.
    """
    there, left, taken = store.cut(edges.select("child", "parent").distinct()), wanted.select("child", "parent").where("child <> parent").distinct(), None
    while True:
        known = there if taken is None else there.union(taken)
        ends = left.select(F.col("parent").alias("start"))
        back = _reached(known, ends).select(F.col("start").alias("parent"), F.col("node").alias("child"))
        left = store.cut(left.join(back, ["child", "parent"], "left_anti"))
        # a wanted edge lies on a cycle if its parent reaches its child over known and wanted edges
        reach = store.cut(_reached(known.union(left), left.select(F.col("parent").alias("start")).union(left.select("child"))))
        ring = left.join(reach.select(F.col("start").alias("parent"), F.col("node").alias("child")), ["child", "parent"], "left_semi")
        around = reach.join(reach.select(F.col("node").alias("start"), F.col("start").alias("node")), ["start", "node"]).groupBy(F.col("start").alias("child")).agg(F.min("node").alias("knot"))
        pick = store.cut(ring.join(around, "child").groupBy("knot").agg(F.min(F.struct("child", "parent")).alias("e")).select("e.child", "e.parent"))
        if pick.isEmpty():
            return left if taken is None else left.union(taken)
        taken = pick if taken is None else store.cut(taken.union(pick))
        left = left.join(pick, ["child", "parent"], "left_anti")


def reduce(edges: DataFrame, added: DataFrame) -> DataFrame:
    """edges and added (child, parent), without those direct edges that two added ones lead around."""
    mid = added.alias("a").join(added.select(F.col("child").alias("m"), F.col("parent").alias("top")), F.col("a.parent") == F.col("m")).select("child", F.col("top").alias("parent"))
    return edges.select("child", "parent").union(added.select("child", "parent")).distinct().join(mid, ["child", "parent"], "left_anti")


def merge(edges: DataFrame, same: DataFrame) -> DataFrame:
    """edges (child, parent) with each dup of same (dup, keep) replaced; no loops."""
    for end in ("child", "parent"):
        edges = edges.join(same.select(F.col("dup").alias(end), F.col("keep").alias("_k")), end, "left").withColumn(end, F.coalesce("_k", end)).drop("_k")
    return edges.select("child", "parent").where("child <> parent").distinct()


def merge_instances(instances: DataFrame, same: DataFrame) -> DataFrame:
    """instances (entity, concept) with each dup of same (dup, keep) replaced."""
    to = same.select(F.col("dup").alias("concept"), F.col("keep").alias("_k"))
    return instances.join(to, "concept", "left").select("entity", F.coalesce("_k", "concept").alias("concept"))


def duplicates(same: DataFrame) -> DataFrame:
    """(dup, keep) of answers (concept, other) that call two concepts the same, applied in the order of concepts.

    A concept goes into the first one that its answer names, unless that one has itself gone before; what goes into a concept that
    goes later follows it. Each round decides the concepts whose target is decided; then ends of chains are looked up, doubling.
    """
    own = same.where("concept <> other").groupBy("concept").agg(F.min("other").alias("other"))
    state = store.cut(own.select("concept", "other", F.when(F.col("other") > F.col("concept"), True).alias("goes")))
    while not state.where("goes is null").isEmpty():
        step = state.join(state.select(F.col("concept").alias("other"), F.col("goes").alias("_g"), F.lit(True).alias("_is")), "other", "left")
        goes = F.when(F.col("goes").isNotNull(), F.col("goes")).when(F.col("_is").isNull(), F.lit(True)).when(F.col("_g").isNotNull(), ~F.col("_g"))
        state = store.cut(step.select("concept", "other", goes.alias("goes")))
    to = store.cut(state.where("goes").select(F.col("concept").alias("dup"), F.col("other").alias("keep")))
    while True:
        further = to.join(to.select(F.col("dup").alias("keep"), F.col("keep").alias("_to")), "keep", "left").select("dup", F.coalesce("_to", "keep").alias("keep"), F.col("_to").isNotNull().alias("_moved"))
        further = store.cut(further)
        to = further.select("dup", "keep")
        if further.where("_moved").isEmpty():
            return to


def hierarchy(concepts: DataFrame, edges: DataFrame, instances: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """concepts (concept, n, done, ...), edges (child, parent) and instances (entity, concept) after answers (concept, other, rel) about
    mature concepts that were not placed before; these then count as done.

    `same` merges a concept into the other and ends its turn; `parent` and `child` are edges to and from the other, unless that
    one has gone by then. Edges that would close a cycle go, and so does a direct edge that two new ones lead around.
    """
    turn = concepts.where((F.col("n") >= DEFINE_AT) & ~F.coalesce("done", F.lit(False))).select("concept")
    there = concepts.select(F.col("concept").alias("other"))
    told = store.cut(answers.where("concept <> other").join(turn, "concept", "left_semi").join(there, "other", "left_semi").select("concept", "other", "rel"))
    same = duplicates(told.where("rel = 'same'"))
    gone = same.select(F.col("dup").alias("x"))
    rest = told.where("rel in ('parent', 'child')").join(gone, F.col("concept") == F.col("x"), "left_anti")
    rest = rest.join(gone, (F.col("other") == F.col("x")) & (F.col("x") < F.col("concept")), "left_anti")
    wanted = rest.select(F.when(F.col("rel") == "parent", F.col("concept")).otherwise(F.col("other")).alias("child"), F.when(F.col("rel") == "parent", F.col("other")).otherwise(F.col("concept")).alias("parent"))
    kept = merge(edges, same)
    added = store.cut(place(kept, merge(wanted, same)))
    left = concepts.join(same.select(F.col("dup").alias("concept")), "concept", "left_anti")
    moved = merge_instances(instances, same)
    n = moved.groupBy("concept").agg(F.count(F.lit(1)).alias("_n"))
    done = turn.withColumn("_t", F.lit(True))
    left = left.join(n, "concept", "left").join(done, "concept", "left").withColumn("n", F.coalesce("_n", "n")).withColumn("done", F.coalesce("_t", "done", F.lit(False))).drop("_n", "_t")
    return left, reduce(kept, added), moved


def layer(entities: DataFrame, items: DataFrame, frozen: DataFrame, links: DataFrame, picks: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """concepts (concept, name, type, n, context, mature, done), instances (entity, concept) and subtypes (child, parent) of entities.

    items (id, type, embedding, context): see `vectors_of`. frozen: concepts (id, type, embedding) that are there; links
    (item, pos) picks among an item's candidates of these. The rest is gathered into canopies, where picks (item, concept) names
    concepts that earlier entities founded. relations (concept, other, rel): see `hierarchy`.
    """
    matched = store.cut(match(candidates(items, frozen), links))
    rest = store.cut(items.join(matched.select(F.col("item").alias("id")), "id", "left_anti"))
    _, clusters, near = canopies(rest)
    own = entities.join(rest.select(F.col("id").alias("uuid")), "uuid", "left_semi")
    new, instances = found_concepts(own, clusters, picks, near)
    instances = store.cut(instances.unionByName(matched.select(F.col("item").alias("entity"), "concept")))
    said = instances.join(items.select(F.col("id").alias("entity"), "context"), "entity").select("concept", F.col("entity").alias("seq"), "context")
    old = frozen.select(F.col("id").alias("concept"), F.lit(None).cast("string").alias("name"), "type")
    concepts = new.unionByName(old).join(maturity(said), "concept", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("done", F.lit(False))
    none = instances.select(F.col("entity").alias("child"), F.col("concept").alias("parent")).where("false")
    concepts, subtypes, instances = hierarchy(store.cut(concepts), none, instances, relations)
    return concepts, instances, subtypes


def rows_to_persist(concepts: DataFrame, instances: DataFrame, subtypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concept nodes (uuid, name, type, definition, n_instances, defined, hierarchy_done) and their edges (src, dst, type, rel), once each."""
    nodes = concepts.select(F.col("concept").alias("uuid"), "name", "type", F.coalesce("context", F.lit("")).alias("definition"), F.col("n").alias("n_instances"), F.coalesce("mature", F.lit(False)).alias("defined"), F.col("done").alias("hierarchy_done"))
    edge = lambda d, a, b, t: d.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("type"), F.lit("").alias("rel"))
    return nodes, edge(instances, "entity", "concept", "INSTANCE_OF").union(edge(subtypes, "child", "parent", "SUBTYPE_OF")).distinct()
