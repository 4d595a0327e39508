"""What travels: groups that are spread, ids as bytes, and results that do not depend on how rows lie."""

import re

import pytest
from factloom.functions import ids
from factloom.operators import analytics, concepts, dedup, graph, paths, runs, similar
from factloom.plans import catalog
from factloom.sources import exports, store
from pyspark.sql import functions as F


def exchanges(df) -> list[str]:
    """The shuffles of a plan, as Spark names them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange (\w+)\(", plan)


def test_ids_come_back(spark):
    names = ["ab" * 20, "AB" * 20, "a" * 41, "c0ffee", "", "\x01x", "анод", "0123456789abcdef", None]
    got = spark.createDataFrame([(n,) for n in names], "s string").select("s", ids.unpack(ids.pack("s")).alias("t"), F.length(ids.pack("s")).alias("n")).collect()
    assert [r.t for r in got] == names and got[0].n == 21


@pytest.mark.parametrize("k", [1, 3, 500])
def test_first_of_groups_over_ranges(spark, k):
    """Groups of one row, a group over all ranges, and one that a batch's end cuts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("hub", i) for i in range(200)] + [(f"a{i:02}", i) for i in range(30)] + [("z", i) for i in range(9)]
        df = spark.createDataFrame(rows, "g string, v int").repartition(3).repartitionByRange(6, "g", "v")
        got = {r.g: (r.n, [x.v for x in r.items]) for r in runs.first(df, ["g"], ["v"], k).collect()}
        want = {}
        for g, v in rows:
            want.setdefault(g, []).append(v)
        assert got == {g: (len(vs), sorted(vs)[:k]) for g, vs in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_neighbours_travel_once(spark):
    edges = spark.createDataFrame([(f"{i:040x}", f"m{i % 3}", t) for i in range(90) for t in ("A", "B")], "src string, dst string, type string")
    near = graph.neighbors(graph.adjacency(edges.withColumn("eid", F.md5(F.concat_ws("|", "src", "dst", "type")))), 5)
    by = analytics.neighbours_by_relation(graph.adjacency(edges))
    for df in (near, by):
        assert exchanges(df).count("rangepartitioning") >= 1
        assert df.groupBy("node").count().where("node = 'm1'").first()["count"] == (5 if df is near else 2)
    assert {(r.n, len(r.others)) for r in by.where("node like 'm%'").collect()} == {(30, 5)}


FACT = "uuid string, frame_type string, sig string, q_value double, q_unit string, q_operator string"


def test_equal_facts_of_one_key_are_spread(spark):
    """A key that all ranges hold has one first fact, also where ids are no digests; no shuffle is dealt by a key's hash."""
    rows = [(f"{i:040x}", "M", "m1", 1.0, "u", "=") for i in range(5, 400)] + [("zz", "M", "m1", 1.0, "u", "="), ("0zz", "M", "m2", None, None, None), ("00" * 8, "M", "m2", None, None, None)]
    got = dedup.exact_dedup(spark.createDataFrame(rows, FACT).repartition(5))
    assert {r.canon for r in got.where("sig = 'm1'").collect()} == {f"{5:040x}"} and {r.canon for r in got.where("sig = 'm2'").collect()} == {"00" * 8}
    assert got.where("keep").count() == 2 and got.count() == len(rows)
    assert all("uuid" not in x and "canon" not in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString()))


def test_verdicts_cost_one_deal_of_facts(spark):
    """Facts are dealt once by their group, whatever the verdicts say."""
    facts = spark.createDataFrame([(f"{i:040x}", "M", f"m{i % 3}", float(i), "u", "=") for i in range(30)], FACT)
    groups = store.cut(dedup.conflict_groups(facts))
    lists = groups.where("sig = 'm0'").select("group_id", F.lit("duplicates").alias("kind"), F.lit(0).alias("list"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("id", F.col("pos"))
    status, star, gone = dedup.contest(facts, groups, groups.where("sig = 'm0'").select("group_id"), lists)
    assert exchanges(status) == exchanges(star) == exchanges(gone) == []
    assert [r.fact for r in gone.collect()] == [f"{3:040x}"] and status.count() == 20 and star.count() == 18


def test_candidates_are_ranked_by_whole_scores(spark):
    """Scores that agree in 6 digits keep their order; equal vectors that lie in different blocks are ties, the smaller id first."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 2e-4]), (3, [1.0, 1e-4]), (4, [1.0, 3e-4])] + [(10 + i, [0.3, 0.7]) for i in range(20)]
    df = spark.createDataFrame([(i, 0, v) for i, v in rows], "id long, type int, embedding array<double>")
    got = {r.item: [] for r in df.select(F.col("id").alias("item")).collect()}
    for r in concepts.candidates(df, df, k=3, least=0.1).orderBy("item", "pos").collect():
        got[r["item"]].append(r.concept)
    assert got[1] == [3, 2, 4] and got[10] == [11, 12, 13] and got[29] == [10, 11, 12]
    assert {r.a for r in similar.join(df, df, 0.1, top=2, block=4, whole=True).where("a = b").collect()} >= {1, 10}


def test_every_vector_asks_for_concepts(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 20 <> 0").select("vec_id")
    assert catalog.queries()["c_topk"](spark, d).join(n, F.col("item") == F.col("vec_id")).count() > 0


def test_edges_with_missing_ends_of_any_kind(spark):
    """A source that all ranges hold, missing and null ends, repeated edges; nothing is dealt by the hash of an end's id."""
    rows = [("hub", f"{i:040x}", "T", None) for i in range(50)] * 2 + [("hub", "gone", "T", None), ("gone", "hub", "T", "x"), (None, "hub", "T", "x"), ("hub", None, "T", "x"), ("hub", "hub", "T", "x"), ("hub", "hub", "T", "")]
    nodes = spark.createDataFrame([("hub",), (None,), ("hub",)] + [(f"{i:040x}",) for i in range(50)], "node string")
    got = store.upsert_edges(spark.createDataFrame(rows, "src string, dst string, type string, rel string").repartition(5), nodes)
    assert sorted((r.src, r.dst, r.type, r.rel) for r in got.collect()) == sorted({("hub", f"{i:040x}", "T", "") for i in range(50)} | {("hub", "hub", "T", "x"), ("hub", "hub", "T", "")})
    assert exchanges(got).count("rangepartitioning") >= 1 and not any("src" in x for x in re.findall(r"hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString()))


def test_a_papers_facts_are_not_dealt(spark):
    """All edges stay where they are when a paper goes."""
    facts = spark.createDataFrame([(f"{i:040x}", str(i % 9)) for i in range(90)], "uuid string, paper_ref string")
    edges = spark.createDataFrame([(f"{i:040x}", f"m{i}", "T") for i in range(90)], "src string, dst string, type string")
    f, e, n = store.delete_paper(facts, edges, spark.createDataFrame([(f"m{i}",) for i in range(90)], "uuid string"), "7")
    assert exchanges(e) == [] and (f.count(), e.count(), n.count()) == (80, 80, 80)


def test_participants_lie_with_their_fact(spark):
    """Names are gathered, joined to facts and traced without another shuffle of participants; a name of two types is one link."""
    edges = spark.createDataFrame([(f"{i:040x}", f"e{i % 4}", "T") for i in range(20)] * 2 + [(f"{i:040x}", "x", "U") for i in range(20)], "src string, dst string, type string")
    entities = spark.createDataFrame([(f"e{i}", "Material", "one") for i in range(4)] + [("x", "Process", "one")], "uuid string, type string, canonical_name string")
    facts = spark.createDataFrame([(f"{i:040x}", "s") for i in range(21)], "uuid string, statement string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = graph.fact_detail(facts, graph.participants(edges, entities, keyed=True))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"hashpartitioning\(_f", plan)) <= 2 and "hashpartitioning(fact" not in plan and "hashpartitioning(uuid" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.uuid, r.parts) for r in got.collect())[0][1] == {"Material": ["one"], "Process": ["one"]} and got.where("size(parts) = 0").count() == 1
    links = graph.trace(got.select(F.lit(0).alias("pos"), "uuid", "statement", F.lit("").alias("quantity"), F.col("parts").alias("participants"), F.lit("").alias("source"), F.lit("").alias("status")))[1]
    assert links.count() == 20 and links.distinct().count() == 20


@pytest.mark.parametrize("pairs", [[(i, i // 2) for i in range(2, 70)], [(i, i + 1) for i in range(40)], [(0, 1), (1, 2), (2, 0), (5, 0), (1, 1)], [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (0, 4)]])
def test_closure_makes_each_pair_of_a_tree_once(spark, monkeypatch, pairs):
    written = []
    cut = store.cut
    monkeypatch.setattr(store, "cut", lambda df: (written.append(df.count()), cut(df))[1])
    got = paths.closure(spark.createDataFrame(pairs, "a long, b long"))
    up = {a: {b for x, b in pairs if x == a} for a in {x for p in pairs for x in p}}
    while any(up[a] != (new := up[a].union(*(up[b] for b in up[a]))) and not up.update({a: new}) for a in list(up)):
        pass
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in up for b in up[a])
    if pairs[0] == (2, 1):  # a tree: pairs are written once, and a jump a node
        assert sum(written) <= got.count() + 70 * 3


def test_hubs_are_counted_before_they_are_shuffled(spark):
    edges = spark.createDataFrame([(f"f{i}", "hub", "T") for i in range(500)], "src string, dst string, type string")
    nodes = spark.createDataFrame([("hub", "RU", 1.0, 2.0, None), ("f1", "RU", 1.0, 2.0, None), ("lone", "RU", None, None, 5.0)], "node string, geography string, low double, high double, value double")
    got = analytics.research(nodes, graph.adjacency(edges), [], None, 0.5)
    assert [tuple(r) for r in got.collect()] == [("hub", 500), ("f1", 1), ("lone", 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan


def test_exported_links_travel_as_bytes(spark):
    links = spark.createDataFrame([(f"{i:040x}", f"m{i % 3}", "T") for i in range(30)], "node string, other string, type string")
    got = exports.subgraph_lines(links, spark.createDataFrame([("m0", "name", "Material")], "uuid string, canonical_name string, type string"))
    assert "(_o" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("line like '%\"name\":\"name\"%'").count() == 10 and got.where(F.col("center") == f"{7:040x}").first().other == "m1"
