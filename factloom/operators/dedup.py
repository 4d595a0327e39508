"""Canonical entities and facts: key merges, signatures, exact duplicates, conflict groups and verdicts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions import ids
from factloom.operators import runs
from factloom.sources import store


#: what equal facts agree in, beside their signature (fixed values)
EQUAL = ["frame_type", "q_value", "q_unit", "q_operator"]


def key_merge(entities: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(old, canon): entities of one key, within `scope` if given, become its first one, in the order of their ids.

    Keys' minima are combined before they are shuffled and joined back, so no window gathers a key."""
    by = [*(scope or []), "entity_key"]
    first = entities.groupBy(*by).agg(F.min("uuid").alias("canon"))
    return entities.select(*by, F.col("uuid").alias("old")).join(first, by).select("old", "canon")


def merge_by_key(entities: DataFrame) -> DataFrame:
    """One row a key: the first id, name and type, all other names and aliases sorted, and, if entities have the column
    `provenance` (array), all of it in the order of their ids. Partial aggregation keeps hot keys small."""
    aliases = F.array_distinct(F.flatten(F.collect_set("aliases"))) if "aliases" in entities.columns else F.array().cast("array<string>")
    more = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("uuid", "provenance"))), lambda x: x["provenance"])).alias("provenance")] if "provenance" in entities.columns else []
    own = entities.groupBy("entity_key").agg(F.min("uuid").alias("uuid"), F.min_by("canonical_name", "uuid").alias("canonical_name"), F.min_by("type", "uuid").alias("type"), F.collect_set("canonical_name").alias("names"), aliases.alias("more"), *more)
    every = F.array_sort(F.array_except(F.array_union("names", F.filter("more", lambda x: x.isNotNull())), F.array("canonical_name")))
    return own.select("entity_key", "uuid", "type", "canonical_name", every.alias("aliases"), *(["provenance"] if more else []))


def signatures(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """facts with `sig`: the sorted distinct entities at the end of all edges but discourse ones; facts without any go.

    Edges and facts meet by a digest of the fact's id, and each travels once."""
    ends = edges.where(~F.col("type").isin(vocab.DISCOURSE)).select(ids.digest("src").alias("_f"), ids.pack("dst").alias("_d")).where("_f is not null").repartition("_f")
    own = ends.groupBy("_f").agg(F.array_join(F.array_sort(F.transform(F.collect_set("_d"), ids.unpack)), ",").alias("sig"))
    light = facts.withColumns({"_f": ids.digest("uuid"), "uuid": ids.pack("uuid")})
    return light.join(own, "_f").drop("_f").withColumn("uuid", ids.unpack("uuid"))


def exact_dedup(signed: DataFrame, strict: bool = False) -> DataFrame:
    """`keep` tells the first fact (by id) of those with equal frame type, signature, value, unit and operator (`canon`).

    As in the model, facts without a quantity are equal whatever they state; strict adds the statement. Facts are dealt by ranges
    of a digest, which tells null from all values, and their id, so equal ones of any number are spread and each travels once.
    """
    by = ["frame_type", "sig", "q_value", "q_unit", "q_operator"] + (["statement"] if strict else [])
    light = signed.withColumns({"_k": ids.digest(*by), "uuid": ids.pack("uuid")})
    dealt = light.repartitionByRange("_k", "uuid").withColumn("uuid", ids.unpack("uuid"))
    return runs.lead(dealt, "_k", "uuid", "canon").drop("_k").withColumn("keep", F.col("uuid") == F.col("canon"))


def conflict_groups(kept: DataFrame) -> DataFrame:
    """(group_id, frame_type, sig, n): signatures with two representatives at least."""
    light = kept.select(ids.digest("frame_type", "sig").alias("_g"), ids.pack("uuid").alias("_u"), "frame_type", "sig")
    g = light.groupBy("_g").agg(F.first("frame_type").alias("frame_type"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"), ids.least("_u").alias("group_id"))
    return g.where("n >= 2").select("frame_type", "sig", "n", "group_id")


def group_participants(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, participants): the sorted names of the entities in a group's signature; an unknown one is named by its id."""
    ends = groups.select("group_id", F.explode(F.split("sig", ",")).alias("uuid"))
    named = ends.join(entities.select("uuid", "canonical_name"), "uuid", "left")
    return named.groupBy("group_id").agg(F.sort_array(F.collect_list(F.coalesce("canonical_name", "uuid"))).alias("participants"))


def _told(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(_g, _u, uuid, id) and what else groups have, beside frame_type, sig and n: a group's representatives, numbered from 0 in the
    order of their ids, as verdicts call them. Facts travel once, as bytes, by a digest of the group's key."""
    key = F.when(F.col("frame_type").isNotNull() & F.col("sig").isNotNull(), ids.digest("frame_type", "sig")).alias("_g")
    more = [c for c in groups.columns if c not in ("frame_type", "sig", "n")]
    own = kept.select(key, ids.pack("uuid").alias("_u")).join(groups.select(key, *more), "_g").withColumn("uuid", ids.unpack("_u"))
    return own.withColumn("id", F.row_number().over(Window.partitionBy("_g").orderBy("uuid")) - 1)


def group_facts(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, id, uuid): a group's representatives, numbered from 0 in the order of their ids, as verdicts call them."""
    return _told(kept, groups.select("frame_type", "sig", "group_id")).select("group_id", "id", "uuid")


def contest(kept: DataFrame, groups: DataFrame, answered: DataFrame | None = None, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fact, status), star edges (src, dst, type), and (fact) that go.

    A group without a verdict (answered: group_id) is contested as a whole, with edges from its first fact. A verdict's lists
    (group_id, kind, list, pos, id) name facts of the group: of `duplicates` all but the list's first go; the facts of
    `contradictions` that did not go are contested, with edges from the first of them. Numbers that no fact has are passed over.

    A verdict is as short as an answer, so its lists come to the group as one array. All that follows is decided where the
    group's facts are, and written once.
    """
    key = groups.select("frame_type", "sig", "group_id")
    none = F.array().cast("array<struct<kind:string,list:int,pos:int,id:int>>")
    if answered is None:
        key = key.select("frame_type", "sig", F.lit(False).alias("_a"), none.alias("_l"))
    else:
        said = lists.groupBy("group_id").agg(F.collect_list(F.struct("kind", F.col("list").cast("int").alias("list"), F.col("pos").cast("int").alias("pos"), F.col("id").cast("int").alias("id"))).alias("_l"))
        key = key.join(said, "group_id", "left").join(answered.select("group_id", F.lit(True).alias("_a")).distinct(), "group_id", "left")
        key = key.select("frame_type", "sig", F.coalesce("_a", F.lit(False)).alias("_a"), F.coalesce("_l", none).alias("_l"))
    mute = F.array(F.struct(F.lit("mute").alias("kind"), F.lit(0).alias("list"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("id")))
    named = F.filter("_l", lambda x: x["id"] == F.col("id"))
    rows = _told(kept, key).select("_g", "_u", F.explode(F.when(F.col("_a"), named).otherwise(F.concat(named, mute))).alias("x")).select("_g", "_u", "x.kind", "x.list", "x.pos")
    first = F.row_number().over(Window.partitionBy("_g", "list", "kind").orderBy("pos"))
    rows = rows.withColumn("_r", first).withColumn("_gone", F.max((F.col("kind") == "duplicates") & (F.col("_r") > 1)).over(Window.partitionBy("_g", "_u")))
    open_ = (F.col("kind") == "mute") | ((F.col("kind") == "contradictions") & ~F.col("_gone"))
    rows = rows.select("_g", "_u", "list", "pos", "_gone", F.coalesce(open_, F.lit(False)).alias("_open"))
    rows = rows.withColumn("_src", F.min_by("_u", "pos").over(Window.partitionBy("_g", "list", "_open")))
    # the first row of a fact speaks for its status, the first of a pair for its edge
    once = lambda *by: F.row_number().over(Window.partitionBy("_g", "_u", *by).orderBy("list", "pos")) == 1
    rows = store.cut(rows.withColumn("_one", once("_open")).withColumn("_edge", F.col("_open") & (F.col("_u") != F.col("_src")) & once("_open", "_src")).select("_u", "_open", "_gone", "_one", "_edge", F.when(F.col("_edge"), F.col("_src")).alias("_src")).where("_one or _edge"))
    status = rows.where("_open and _one").select(ids.unpack("_u").alias("fact"), F.lit("contested").alias("status"))
    star = rows.where("_edge").select(ids.unpack("_src").alias("src"), ids.unpack("_u").alias("dst"), F.lit("CONTRADICTED_BY").alias("type"))
    # a fact that goes has a row of duplicates, which is not open
    return status, star, rows.where("_gone and _one and not _open").select(ids.unpack("_u").alias("fact"))


def contexts(facts: DataFrame, members: DataFrame, k: int = 3, cap: int = 120) -> DataFrame:
    """(entity, context): each entity's first k statements, `cap` characters of each, joined by '; '."""
    from factloom.operators import graph

    say = facts.select(ids.digest("uuid").alias("_f"), ids.pack("uuid").alias("_u"), F.substring("statement", 1, cap).alias("statement"))
    own = graph.keyed(members).select("_f", ids.pack("entity").alias("_e")).join(say, "_f").select("_e", "statement", ids.unpack("_u").alias("fact"))
    rank = F.row_number().over(Window.partitionBy("_e").orderBy("fact"))
    few = own.withColumn("rank", rank).where(F.col("rank") <= k)
    return few.groupBy("_e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("statement").alias("s")))), lambda x: x["s"]), "; ").alias("context")).select(ids.unpack("_e").alias("entity"), "context")


def near_merge(pairs: DataFrame) -> DataFrame:
    """(grp, old, canon) of pairs (grp, pos, a, b) that a judge called the same, taken in the order of pos: b goes into a, unless
    either went into another one before; what went into b follows. A group is the entities of one type in one paper, so its
    pairs fit one row, in which they are worked through in order.
    """
    told = pairs.where("a is not null and b is not null and a <> b").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("ps"))
    kind = dict(pairs.dtypes)["a"]
    none = F.array().cast(f"array<struct<old:{kind},canon:{kind}>>")

    def step(done: Column, p: Column) -> Column:
        gone = F.transform(done, lambda x: x["old"])
        moved = F.transform(done, lambda x: F.struct(x["old"].alias("old"), F.when(x["canon"] == p["b"], p["a"]).otherwise(x["canon"]).alias("canon")))
        more = F.array(F.struct(p["b"].alias("old"), p["a"].alias("canon")))
        return F.when(F.array_contains(gone, p["a"]) | F.array_contains(gone, p["b"]), done).otherwise(F.concat(moved, more))

    return told.select("grp", F.explode(F.aggregate("ps", none, step)).alias("m")).select("grp", "m.old", "m.canon")


def link_chain(facts: DataFrame, entities: DataFrame, edges: DataFrame, clusters: DataFrame | None = None, relations: DataFrame | None = None, predicates: DataFrame | None = None, answered: DataFrame | None = None, lists: DataFrame | None = None, approved: DataFrame | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts, entities and edges after all linking: entities resolved, open predicates named, facts deduplicated, claims supported.

    Entities of one key become one, then those that clusters (grp, cluster, pos, name; grp is the type) join; edges follow,
    and relations (grp, child, parent, rel) add those of the hierarchy. Open edges take the core types of predicates (rel,
    core_type). Equal facts become one, verdicts (answered, lists: see `contest`) drop or contest others, and edges of facts that
    went go too. Candidates (claim, measurement) that were approved become SUPPORTED_BY edges. A verdict table that is missing is a
    judge that did not answer: its step leaves the rows as they are, but unanswered conflicts are contested.
    """
    from factloom.operators import graph, resolution

    keys = key_merge(entities)
    one = merge_by_key(entities)
    mapping = keys
    if clusters is not None:
        named = one.select(F.col("type").alias("grp"), "uuid", "canonical_name", "aliases")
        more = resolution.merges(named, clusters)
        to = more.select(F.col("old").alias("canon"), F.col("canon").alias("_to"))
        mapping = keys.join(to, "canon", "left").select("old", F.coalesce("_to", "canon").alias("canon"))
        victims = one.join(more.select(F.col("old").alias("uuid"), "canon"), "uuid").select(F.col("canon").alias("uuid"), F.array_union(F.array("canonical_name"), "aliases").alias("_a")).groupBy("uuid").agg(F.array_distinct(F.flatten(F.collect_list("_a"))).alias("_a"))
        one = one.join(more.select(F.col("old").alias("uuid")), "uuid", "left_anti").join(victims, "uuid", "left")
        one = one.withColumn("aliases", F.array_sort(F.array_except(F.array_union("aliases", F.coalesce("_a", F.array().cast("array<string>"))), F.array("canonical_name")))).drop("_a")
    columns = [c for c in ("src", "dst", "type", "rel", "rel_def") if c in edges.columns]
    # edges are rewired and written as bytes; what follows reads them
    light = edges.select([ids.pack(c).alias(c) if c in ("src", "dst") else c for c in columns])
    moved = store.cut(graph.rewire(light, mapping.where("old <> canon").select(ids.pack("old").alias("old"), ids.pack("canon").alias("canon"))))
    moved = moved.withColumns({c: ids.unpack(c) for c in ("src", "dst")})
    for c in ("rel", "rel_def"):
        moved = moved if c in columns else moved.withColumn(c, F.lit(None).cast("string"))
    if relations is not None:
        named = entities.select(F.col("type").alias("grp"), "uuid", "canonical_name", F.col("aliases") if "aliases" in entities.columns else F.array().cast("array<string>").alias("aliases"))
        new = resolution.relations(named, moved.select("src", "dst", "type"), relations, mapping)
        moved = moved.unionByName(new.withColumn("rel", F.lit(None).cast("string")).withColumn("rel_def", F.lit(None).cast("string")))
    if predicates is not None:
        moved = resolution.canon_predicates(moved, predicates, vocab.EDGE_TYPES)
    deduped = exact_dedup(signatures(facts.select("uuid", *EQUAL, *(["statement"] if strict else [])), moved), strict)
    kept = store.cut(deduped.select(ids.pack("uuid").alias("uuid"), "frame_type", "sig", "keep"))
    reps = kept.where("keep").withColumn("uuid", ids.unpack("uuid"))
    status, star, gone = contest(reps, conflict_groups(reps), answered, lists)
    drop = kept.where("not keep").select(F.col("uuid").alias("fact")).union(gone.select(ids.pack("fact")))
    status = status.select(ids.pack("fact").alias("fact"), F.col("status").alias("_s"))
    left = facts.withColumn("uuid", ids.pack("uuid")).join(drop, F.col("uuid") == F.col("fact"), "left_anti").join(status, F.col("uuid") == F.col("fact"), "left").drop("fact")
    left = left.withColumn("status", F.coalesce("_s", "status")).withColumn("uuid", ids.unpack("uuid")).drop("_s")
    none = F.lit(None).cast("string")
    moved = moved.withColumns({c: ids.pack(c) for c in ("src", "dst")}).join(drop, F.col("src") == F.col("fact"), "left_anti").join(drop, F.col("dst") == F.col("fact"), "left_anti")
    moved = moved if approved is None else store.cut(moved)  # read again for the candidates
    moved = moved.withColumns({c: ids.unpack(c) for c in ("src", "dst")})
    moved = moved.unionByName(star.select("src", "dst", "type", none.alias("rel"), none.alias("rel_def")))
    if approved is not None:
        support = resolution.stitch(graph.stitch_candidates(left, moved), approved)
        moved = moved.unionByName(support.select("src", "dst", "type", none.alias("rel"), none.alias("rel_def")))
    return left, one, moved
