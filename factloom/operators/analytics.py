"""Analytics over the graph: counts, gaps, geography, experts, heat map, research query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import ids, text
from factloom.operators import graph, runs


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


# The explorer's graph: nodes (node, kind, label, name, statement, geography, source, is_gap, low, high, value) and links (node,
# other, type), every edge from both of its ends. WITHOUT_CONDITIONS need none; DIRECT, SHARED and NONE are the heat map's levels.
WITHOUT_CONDITIONS = ["Condition", "Publication", "Expert", "Facility"]  # fixed values
DIRECT, SHARED, NONE = 3, 2, 0  # fixed values


def in_geography(geography: Column, wanted: str | None) -> Column:
    """Whether a node passes a geography filter: any without one; a node without geography, of the wanted one, or of both."""
    if wanted is None or wanted == "all":
        return F.lit(True)
    return F.coalesce(geography == "", F.lit(True)) | geography.isin(wanted, "RU+world")


def visible(nodes: DataFrame, kinds: list[str] | None = None, geography: str | None = None) -> DataFrame:
    """nodes with whether they are shown: of the chosen kinds (none chosen: all), and of the geography."""
    kind = F.col("kind").isin(kinds) if kinds else F.lit(True)
    return nodes.withColumn("visible", kind & in_geography(F.col("geography"), geography))


def visible_links(links: DataFrame, active: list[str]) -> DataFrame:
    """links with whether their type is switched on."""
    return links.withColumn("visible", F.col("type").isin(active))


def search(nodes: DataFrame, term: str) -> DataFrame:
    """nodes whose label, or else name, or statement where there is no name, holds the trimmed, lower-cased term; none for a blank one."""
    t = term.strip().lower()
    said = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("statement"), F.lit("")), F.lit(""))
    return nodes.where(F.lit(bool(t)) & (F.lower(F.coalesce("label", F.lit(""))).contains(t) | F.lower(said).contains(t)))


def neighbours_by_relation(links: DataFrame) -> DataFrame:
    """(node, type, n, others): the different neighbours of each node over each type, sorted, the first five of them named.

    Links travel once, in ranges of node, type and neighbour, so a node of any degree is spread; their ids are bytes."""
    dealt = links.select(ids.pack("node").alias("_n"), "type", ids.pack("other").alias("_o")).repartitionByRange("_n", "type", "_o")
    few = runs.first(dealt.distinct().withColumn("other", ids.unpack("_o")), ["_n", "type"], ["other"], 5)
    return few.select(ids.unpack("_n").alias("node"), "type", "n", F.transform("items", lambda x: x["other"]).alias("others"))


def summary(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, links, sources, no_source, no_conditions, lonely, disputed): what a node's card counts and warns of."""
    has = lambda *types: F.count_if(F.col("type").isin(*types))
    near = links.where(F.col("type").isin("DESCRIBED_IN", "VALIDATED_BY")).groupBy("node").agg(F.countDistinct("other").alias("sources"))
    g = links.groupBy("node").agg(F.count(F.lit(1)).alias("links"), has("OPERATES_AT_CONDITION").alias("c"), has("CONTRADICTS").alias("d"))
    told = nodes.select("node", "kind").join(g, "node", "left").join(near, "node", "left").fillna(0, ["links", "c", "d", "sources"])
    return told.select("node", "links", "sources", (F.col("sources") == 0).alias("no_source"), ((F.col("c") == 0) & ~F.coalesce(F.col("kind").isin(WITHOUT_CONDITIONS), F.lit(False))).alias("no_conditions"), (F.col("links") <= 1).alias("lonely"), (F.col("d") > 0).alias("disputed"))


def gaps(nodes: DataFrame, links: DataFrame, most: int = 1) -> DataFrame:
    """(node, reason, degree, processes, conditions): findings that say they are gaps, and materials with at most `most` links."""
    kinds = nodes.select(F.col("node").alias("other"), F.col("kind").alias("k"))
    own = links.join(nodes.where("kind = 'Material'").select("node"), "node", "left_semi").join(kinds, "other", "left")
    d = own.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_if(F.col("k") == "Process").alias("processes"), F.count_if(F.col("k") == "Condition").alias("conditions"))
    sparse = nodes.where("kind = 'Material'").select("node").join(d, "node", "left").fillna(0).where(F.col("degree") <= most)
    none = F.lit(None).cast("long")
    said = nodes.where("kind = 'Finding' and coalesce(is_gap, false)").select("node", F.lit("said").alias("reason"), none.alias("degree"), none.alias("processes"), none.alias("conditions"))
    return said.unionByName(sparse.withColumn("reason", F.lit("sparse")))


def geography(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(geography, n) over all nodes, blank for none; (folder, members, ru, world, zero_ru) of the folders A to F that have
    members; and one row (pure_ru, total) of materials and processes."""
    place = F.coalesce("geography", F.lit(""))
    overall = nodes.groupBy(place.alias("geography")).agg(F.count(F.lit(1)).alias("n"))
    own = nodes.select(text.cluster(F.col("node"), F.col("source")).alias("folder"), place.alias("g")).where("folder <> 'X'")
    ru, world = F.count_if(F.col("g").isin("RU", "RU+world")), F.count_if(F.col("g").isin("world", "RU+world"))
    folders = own.groupBy("folder").agg(F.count(F.lit(1)).alias("members"), ru.alias("ru"), world.alias("world")).withColumn("zero_ru", F.col("ru") == 0)
    pure = nodes.where("kind in ('Material', 'Process')").agg(F.count_if(F.col("geography") == "RU").alias("pure_ru"), F.count(F.lit(1)).alias("total"))
    return overall, folders, pure


def experts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(expert, authored, works_at, total, share, risk, orphan): links of each expert; share is the rounded percentage of all
    authorships (src, dst, type), a half and more of them a risk; an orphan has no link of either kind."""
    ends = edges.where("type in ('AUTHORED_BY', 'WORKS_AT')")
    both = ends.select(F.col("src").alias("node"), "type").union(ends.select("dst", "type"))
    g = both.groupBy("node").agg(F.count_if(F.col("type") == "AUTHORED_BY").alias("authored"), F.count_if(F.col("type") == "WORKS_AT").alias("works_at"))
    whole = edges.where("type = 'AUTHORED_BY'").agg(F.count(F.lit(1)).alias("whole"))  # one row
    told = nodes.where("kind = 'Expert'").select("node").join(g, "node", "left").fillna(0).crossJoin(F.broadcast(whole))
    share = F.when(F.col("whole") > 0, F.floor(F.col("authored") * 100.0 / F.col("whole") + 0.5)).otherwise(0).cast("long")
    told = told.withColumn("total", F.col("authored") + F.col("works_at")).withColumn("share", share)
    return told.select(F.col("node").alias("expert"), "authored", "works_at", "total", "share", (F.col("share") >= 50).alias("risk"), (F.col("total") == 0).alias("orphan"))


def heatmap(nodes: DataFrame, links: DataFrame, rows: int = 20, columns: int = 18) -> DataFrame:
    """(material, condition, level) of the first materials and conditions by id: DIRECT for a link, SHARED for a common neighbour,
    else NONE. A way over two more nodes that has no common one does not exist, since every link counts from both ends.

    The numbers of rows and columns are the feature; links are looked up from these few nodes, not from the whole graph."""
    m = nodes.where("kind = 'Material'").select(F.col("node").alias("material")).orderBy("material").limit(rows)
    c = nodes.where("kind = 'Condition'").select(F.col("node").alias("condition")).orderBy("condition").limit(columns)
    near_m = links.join(F.broadcast(m.select(F.col("material").alias("node"))), "node", "left_semi").select(F.col("node").alias("material"), "other").distinct()
    near_c = links.join(F.broadcast(c.select(F.col("condition").alias("node"))), "node", "left_semi").select(F.col("node").alias("condition"), "other").distinct()
    direct = near_m.join(F.broadcast(c), F.col("other") == F.col("condition")).select("material", "condition", F.lit(DIRECT).alias("level"))
    shared = near_m.join(near_c, "other").select("material", "condition", F.lit(SHARED).alias("level")).distinct()
    best = direct.union(shared).groupBy("material", "condition").agg(F.max("level").alias("level"))
    grid = m.crossJoin(F.broadcast(c))  # 20 rows and 18
    return grid.join(best, ["material", "condition"], "left").withColumn("level", F.coalesce("level", F.lit(NONE)))


def research(nodes: DataFrame, links: DataFrame, chosen: list[str], geography: str | None = None, low: float | None = None, high: float | None = None, most: int = 60) -> DataFrame:
    """(node, degree): nodes that are, or are linked to, every one of the chosen ones, of the geography, whose range (low to high, for
    either the value where it is null) meets [low, high]; those with most links first, `most` of them."""
    out, asked = nodes, sorted(set(chosen))
    if asked:  # one pass over the links for all chosen nodes
        near = links.where(F.col("node").isin(asked)).select(F.col("other").alias("n"), F.col("node").alias("x"))
        itself = nodes.where(F.col("node").isin(asked)).select(F.col("node").alias("n"), F.col("node").alias("x"))
        all_of = near.union(itself).groupBy("n").agg(F.countDistinct("x").alias("k")).where(F.col("k") == len(asked))
        out = out.join(all_of.select(F.col("n").alias("node")), "node", "left_semi")
    out = out.where(in_geography(F.col("geography"), geography or None))
    lo, hi = F.coalesce("low", "value"), F.coalesce("high", "value")
    if low is not None or high is not None:
        out = out.where(lo.isNotNull())
    if low is not None:
        out = out.where(F.coalesce(hi, F.lit(0.0)) >= low)
    if high is not None:
        out = out.where(lo <= high)
    # every node's links are counted before they are shuffled, so no node gathers its own, and digests take the place of ids
    own = links.groupBy(ids.digest("node").alias("_n")).agg(F.count(F.lit(1)).alias("degree"))
    told = out.select("node", ids.digest("node").alias("_n")).join(own, "_n", "left").select("node", "degree")
    return told.fillna(0, ["degree"]).orderBy(F.desc("degree"), "node").limit(most)


def grouped(hits: DataFrame, nodes: DataFrame, each: int = 5, context: int = 14) -> tuple[DataFrame, DataFrame]:
    """(kind, node): the first of each kind among hits (node, pos), and (node, name, kind, definition, range, geography, source, pos) of
    the first `context` hits, for the model that words the answer."""
    own = hits.join(nodes, "node")
    r = F.row_number().over(Window.partitionBy("kind").orderBy("pos"))
    few = own.withColumn("r", r).where(F.col("r") <= each).select("kind", "node")
    first = own.orderBy("pos").limit(context)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("statement"), F.lit("")), "node")
    said = F.substring(F.coalesce("statement", F.lit("")), 1, 220)
    return few, first.select("node", name.alias("name"), "kind", said.alias("definition"), graph.value_range(F.col("low"), F.col("high"), F.col("value"), F.lit("")).alias("range"), "geography", "source", "pos")


def occurrences(body, tokens: list[str]):
    """How often the tokens occur in a lower-cased text, summed."""
    each = [F.floor((F.char_length(body) - F.char_length(F.replace(body, F.lit(t), F.lit("")))) / len(t)) for t in tokens]
    return sum(each[1:], each[0]).cast("long")


def graph_rag(nodes: DataFrame, links: DataFrame, tokens: list[str], seeds: int = 8, each: int = 6, most: int = 16) -> DataFrame:
    """(node, score): the best nodes (node, body) by occurrences, and up to `each` neighbours (node, other) of each at 0.3."""
    found = nodes.select("node", occurrences(F.lower("body"), tokens).cast("double").alias("score")).where("score > 0")
    top = found.orderBy(F.desc("score"), "node").limit(seeds)
    near = links.join(F.broadcast(top.select("node")), "node", "left_semi").select("node", "other").distinct()  # at most `seeds` rows
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where(F.col("r") <= each)
    more = few.select(F.col("other").alias("node")).distinct().join(F.broadcast(top.select("node")), "node", "left_anti").withColumn("score", F.lit(0.3))
    return top.union(more).orderBy(F.desc("score"), "node").limit(most)


def literature(nodes: DataFrame, links: DataFrame, disputed: DataFrame, tokens: list[str], most: int = 10) -> DataFrame:
    """(node, place, contested): findings about a topic, by place.

    nodes: node, body, finding (boolean), place. Findings that hold a token, and those linked (node, other) to one of the `most`
    best other nodes; contested ones are in disputed (a, b) with a finding of the result at either end.
    """
    scored = nodes.select("node", "finding", "place", occurrences(F.lower("body"), tokens).alias("score"))
    top = scored.where("not finding and score > 0").orderBy(F.desc("score"), "node").limit(most).select("node")
    near = links.join(F.broadcast(top), "node", "left_semi").select(F.col("other").alias("node"))
    ids = scored.where("finding and score > 0").select("node").union(near).distinct()
    own = scored.where("finding").join(ids, "node", "left_semi")
    pairs = disputed.select("a", "b").union(disputed.select("b", "a"))
    hit = pairs.join(own.select(F.col("node").alias("a")), "a", "left_semi")
    bad = hit.select(F.col("a").alias("node")).union(hit.select("b")).distinct().withColumn("c", F.lit(True))
    return own.join(bad, "node", "left").select("node", F.coalesce("place", F.lit("")).alias("place"), F.coalesce("c", F.lit(False)).alias("contested"))


def compare(props: DataFrame, nodes: list[str], order: list[str]) -> DataFrame:
    """(key, pos, a column a node): the properties (node, key, value) of up to four nodes side by side, known keys first."""
    first = F.array_position(F.array(*map(F.lit, order)), F.col("key"))
    own = props.where(F.col("node").isin(nodes[-4:]) & (F.coalesce("value", F.lit("")) != ""))
    return own.groupBy("key").pivot("node", nodes[-4:]).agg(F.max("value")).withColumn("pos", F.when(first > 0, first).otherwise(len(order) + 1).cast("long"))


def catalogue(items: DataFrame, tokens: list[str], most: int = 6) -> DataFrame:
    """(item, score): the items (item, body) that hold the most of the tokens."""
    held = [F.lower("body").contains(t).cast("long") for t in tokens]
    return items.select("item", sum(held[1:], held[0]).alias("score")).where("score > 0").orderBy(F.desc("score"), "item").limit(most)
