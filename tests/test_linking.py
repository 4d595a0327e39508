"""Hand-made cases of linking, conflicts, concepts, answers, stores and judges."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import answers, concepts, dedup, extraction, graph, judges, papers, resolution, retrieval, similar
from factloom.sources import control, store, vectorindex
from factloom.streaming import events

FACT = "uuid string, frame_type string, sig string, q_value double, q_unit string, q_operator string"


def kept(spark, values, sig="m,p"):
    rows = [(f"f{i}", "MaterialMeasurement", sig, v, "eV", "=") for i, v in enumerate(values)]
    return dedup.exact_dedup(spark.createDataFrame(rows, FACT))


def test_duplicates_and_contradictions_of_a_verdict(spark):
    reps = kept(spark, [1.0, 2.0, 3.0, 4.0]).where("keep")
    groups = dedup.conflict_groups(reps)
    told = spark.createDataFrame([("f0", "duplicates", 0, 0, 0), ("f0", "duplicates", 0, 1, 1), ("f0", "contradictions", 1, 0, 0), ("f0", "contradictions", 1, 1, 2), ("f0", "contradictions", 1, 2, 3), ("f0", "contradictions", 1, 3, 9)], "group_id string, kind string, list int, pos int, id int")
    status, edges, gone = dedup.contest(reps, groups, groups.select("group_id"), told)
    assert {r.fact for r in gone.collect()} == {"f1"} and {r.fact for r in status.collect()} == {"f0", "f2", "f3"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("f0", "f2"), ("f0", "f3")}


def test_one_value_six_times_and_two_others(spark):
    every = kept(spark, [1.6] + [1.7] * 6 + [1.8])
    reps = every.where("keep")
    assert reps.count() == 3 and {r.canon for r in every.where("not keep").collect()} == {"f1"}
    groups = dedup.conflict_groups(reps)
    told = spark.createDataFrame([("f0", "contradictions", 0, i, i) for i in range(3)], "group_id string, kind string, list int, pos int, id int")
    status, edges, gone = dedup.contest(reps, groups, groups.select("group_id"), told)
    assert status.count() == 3 and edges.count() == 2 and gone.count() == 0
    assert dedup.conflict_groups(kept(spark, [1.7] * 5).where("keep")).count() == 0


def test_a_group_without_verdict_is_contested(spark):
    reps = kept(spark, [540.0, 600.0]).where("keep")
    for answered in (None, spark.createDataFrame([], "group_id string")):
        lists = spark.createDataFrame([], "group_id string, kind string, list int, pos int, id int")
        status, edges, gone = dedup.contest(reps, dedup.conflict_groups(reps), answered, lists)
        assert status.count() == 2 and [(r.src, r.dst) for r in edges.collect()] == [("f0", "f1")] and gone.count() == 0


def test_facts_without_a_number_are_equal_unless_strict(spark):
    f = spark.createDataFrame([("a", "ClaimFact", "m", None, None, None, "x"), ("b", "ClaimFact", "m", None, None, None, "y")], FACT + ", statement string")
    assert dedup.exact_dedup(f).where("keep").count() == 1 and dedup.exact_dedup(f, strict=True).where("keep").count() == 2


def test_key_merge_moves_edges_and_keeps_names(spark):
    e = spark.createDataFrame([("u1", "Material", "Ni", "Material:ni", ["n"], ["p1"]), ("u2", "Material", "Nickel", "Material:ni", ["Ni", None], ["p2"])], "uuid string, type string, canonical_name string, entity_key string, aliases array<string>, provenance array<string>")
    one = dedup.merge_by_key(e).first()
    assert (one.uuid, one.canonical_name, one.aliases, one.provenance) == ("u1", "Ni", ["Nickel", "n"], ["p1", "p2"])
    x = spark.createDataFrame([("f1", "u1", "A", "r"), ("f1", "u2", "A", "s"), ("u2", "u1", "OPEN", None)], "src string, dst string, type string, rel string")
    assert sorted((r.src, r.dst, r.type, r.rel or "") for r in graph.rewire(x, dedup.key_merge(e)).collect()) == [("f1", "u1", "A", "r"), ("f1", "u1", "A", "s"), ("u1", "u1", "OPEN", "")]


def test_resolve_merges_and_relates(spark):
    names = ["electronic bandgap", "Egap", "topological band gap"]
    e = spark.createDataFrame([(f"u{i}", "Property", n, f"Property:{i}") for i, n in enumerate(names)], "uuid string, type string, canonical_name string, entity_key string")
    f = spark.createDataFrame([("f1", "ClaimFact", "7", 1.0, "eV", "=", "verified")], "uuid string, frame_type string, paper_ref string, q_value double, q_unit string, q_operator string, status string")
    x = spark.createDataFrame([("f1", "u1", "OPEN", "passivates", "d"), ("f1", "u2", "HAS_PROPERTY", None, None)], "src string, dst string, type string, rel string, rel_def string")
    clusters = spark.createDataFrame([("Property", 0, 0, names[0]), ("Property", 0, 1, names[1]), ("Property", 0, 2, " ")], "grp string, cluster int, pos int, name string")
    relations = spark.createDataFrame([("Property", names[2], names[1], "subtype_of")], "grp string, child string, parent string, rel string")
    facts, entities, edges = dedup.link_chain(f, e, x, clusters, relations, spark.createDataFrame([("passivates", "INHIBITS"), ("passivates", "NOT_A_TYPE")], "rel string, core_type string"))
    assert {r.uuid: r.aliases for r in entities.collect()} == {"u0": ["Egap"], "u2": []}
    assert sorted((r.src, r.dst, r.type, r.rel) for r in edges.collect()) == [("f1", "u0", "INHIBITS", None), ("f1", "u2", "HAS_PROPERTY", None), ("u2", "u0", "SUBTYPE_OF", None)]
    assert [r.status for r in facts.collect()] == ["verified"]


def test_names_are_trimmed_by_blanks_only(spark):
    c = spark.createDataFrame([(["0 alloy", "Ti-1", "  spaced  ", " ", None, "Nb3"],), (["x", " "],)], "names array<string>")
    assert [r.names for r in resolution.clean_clusters(c).collect()] == [["0 alloy", "Ti-1", "spaced", "Nb3"]]


def test_hypotheses_are_claims(spark):
    f = spark.createDataFrame([("h", "HypothesisFact", "1"), ("m", "MaterialMeasurement", "1"), ("n", "MaterialMeasurement", "2")], "uuid string, frame_type string, paper_ref string")
    x = spark.createDataFrame([("h", "u", "MENTIONS"), ("m", "u", "HAS_MATERIAL"), ("n", "u", "HAS_MATERIAL")], "src string, dst string, type string")
    assert [tuple(r) for r in graph.stitch_candidates(f, x).collect()] == [("h", "m")]


def test_mentions_link_by_text(spark):
    e = spark.createDataFrame([("1", "Material", "MoS2", []), ("2", "Material", "W", ["tungsten"]), ("3", "Place", "MoS2 hall", [])], "uuid string, type string, canonical_name string, aliases array<string>")
    link = lambda *m: {r.entity for r in graph.link_mentions(spark.createDataFrame(list(m), "mention string, type string"), e).collect()}
    assert link(("MoS2 films", "Material")) == {"1"} and link((" mos2 ", None)) == {"1", "3"} and link(("mo", None)) == set() and link((" ", None)) == set()
    assert link(("tungsten", "Material")) == {"2"} and link(("MoS2", "Unheard")) == {"1", "3"}


def test_numbers_as_the_model_writes_them(spark):
    values = [1.7, 0.25, 540.0, 1e7, 12345678.5, 1e15, 1e16, 2.5e-4, 1e-5, -1.5e-7, 0.0, 1.5e22]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text.number(F.col("v"))).collect()] == [repr(v) for v in values]
    q = text.quantity(F.lit(None).cast("string"), F.lit("="), F.col("v"), F.lit("eV"))
    assert df.select(q).first()[0] == "=1.7 eV"


@pytest.mark.parametrize("ref,adapter", [("2401.01234", "arxiv"), (" 2401.01234 ", "arxiv"), ("https://arxiv.org/abs/hep-th/", None), ("see arxiv.org/pdf/2401.01234", "arxiv"), ("a.PDF", "pdf"), ("a.txt", None)])
def test_route(spark, ref, adapter):
    assert spark.range(1).select(text.route(F.lit(ref))).first()[0] == adapter


def test_references_of_a_paper_keep_indented_lines_and_digits(spark):
    t = "Intro\nReferences\n[1] A one\n  2. B two\n3 C three\n[4] D\nno number"
    docs = spark.createDataFrame([("p", "s", t, 1)], "paper_ref string, source string, text string, n_pages int")
    assert [r.raw for r in papers.load(docs).first().parsed.refs] == ["[1] A one", "2. B two", "3 C three", "[4] D"]


def test_anchor_across_white_space(spark):
    c = spark.createDataFrame([("c", None, 5, 40, "one\ntwo\n  three four", "     one\ntwo\n  three four")], "chunk string, atomic_ref string, start int, end int, text string, raw_text string")
    tags = spark.createDataFrame([("c", 0, "two three", "claim", 0.9), ("c", 1, "absent", "claim", 0.8)], "chunk string, ord int, anchor string, role string, confidence double")
    for chunks in (c, c.drop("raw_text")):
        assert sorted((r.unit_id, r.start, r.end) for r in extraction.units(chunks, tags).collect()) == [("c-u0", 9, 20), ("c-u1", 5, 40)]


def test_speakers_wait_for_those_they_name(spark):
    names = ["alpha", "5 W at 6 nm", "beta", "gamma", "delta"]
    e = spark.createDataFrame([(i, "t", n) for i, n in enumerate(names)] + [(9, "t", "follower")], "uuid long, type string, canonical_name string")
    clusters = spark.createDataFrame([(i, i) for i in range(5)] + [(9, 2)], "node long, comp long")
    told = spark.createDataFrame([(2, 0), (3, 2), (4, 1)], "item long, concept long")
    new, placed = concepts.found_concepts(e, clusters, told)
    # 2 joins 0; 3 names 2, which founded nothing, and founds; 4 names 1, which is no concept, and founds; 9 follows 2
    assert {r.concept for r in new.collect()} == {0, 3, 4} and {(r.entity, r.concept) for r in placed.collect()} == {(0, 0), (2, 0), (3, 3), (4, 4), (9, 0)}
    near = spark.createDataFrame([(0, 3)], "a long, b long")
    assert {(r.entity, r.concept) for r in concepts.found_concepts(e, clusters, told, near)[1].collect()} == {(0, 0), (2, 2), (3, 3), (4, 4), (9, 2)}


def test_hierarchy_by_hand(spark):
    c = spark.createDataFrame([(x, 3, False) for x in "abcd"] + [("z", 1, False)], "concept string, n long, done boolean")
    i = spark.createDataFrame([("e1", "a"), ("e2", "b")], "entity string, concept string")
    none = spark.createDataFrame([], "child string, parent string")
    told = lambda *r: spark.createDataFrame(list(r), "concept string, other string, rel string")
    left, edges, moved = concepts.hierarchy(c, none, i, told(("a", "b", "same"), ("b", "a", "same"), ("b", "d", "parent"), ("z", "d", "parent")))
    assert {(r.concept, r.n, r.done) for r in left.collect()} == {("b", 2, True), ("c", 3, True), ("d", 3, True), ("z", 1, False)}
    assert [tuple(r) for r in edges.collect()] == [("b", "d")] and {tuple(r) for r in moved.collect()} == {("e1", "b"), ("e2", "b")}
    # no cycle, and a direct edge that two new ones lead around goes
    known = spark.createDataFrame([("b", "d")], "child string, parent string")
    _, edges, _ = concepts.hierarchy(c, known, i, told(("c", "b", "child"), ("c", "d", "parent"), ("d", "b", "parent")))
    assert {tuple(r) for r in edges.collect()} == {("b", "c"), ("c", "d")}


def test_width_and_mentions(spark):
    assert (answers.width(16, 3), answers.width(16, 6), answers.width(16, 1)) == (13, 12, 24)
    none = F.lit(None).cast("array<struct<mention:string,type:string>>")
    assert [tuple(m) for m in spark.range(1).select(answers.mentions(F.lit("why?"), none)).first()[0]] == [("why?", None)]


def test_tagged_ranking_against_plain_code(spark):
    over = [(f"f{i:02d}", i % 4) for i in range(40)]
    lists = [(0, f"f{i:02d}", p) for p, i in enumerate((38, 3, 0, 11))] + [(1, f"f{i:02d}", p) for p, i in enumerate((39, 38, 5))]
    tagged = sorted((x for x in over if x[1]), key=lambda x: (-x[1], x[0]))
    rrf = {}
    for ranked in ([t[0] for t in tagged], *[[x[1] for x in lists if x[0] == n] for n in (0, 1)]):
        for pos, u in enumerate(ranked):
            rrf[u] = rrf.get(u, 0) + 1 / (60 + pos)
    want = sorted(rrf, key=lambda u: (-dict(over)[u], -round(rrf[u], 6), u))[:8]
    got = retrieval.rank_tagged(spark.createDataFrame(over, "fact string, overlap long"), spark.createDataFrame(lists, "list int, id string, pos int"), 8)
    assert [r.id for r in got.collect()] == want


def test_similar_blocks_find_all(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5))
    rows = [(i, f"t{i % 2}" if i % 9 else None, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, "t1", [0.0] * 5), (101, "t1", None)]
    df = spark.createDataFrame(rows, "id long, type string, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 9 and j % 9 and i % 2 == j % 2 and y[i] @ y[j] >= 0.6}
    for block in (7, 1024):
        assert {(r.a, r.b) for r in similar.pairs(df, 0.6, block).collect()} == want
    top = similar.join(df, df, -2.0, top=3, block=7).where("a = 10").orderBy(F.desc("score")).limit(3).collect()
    assert [r.b for r in top] == sorted((j for j in range(90) if j % 9 and j % 2 == 0), key=lambda j: -(y[10] @ y[j]))[:3]


def test_vector_index_is_exact(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 8)), rng.normal(size=(200, 8)) * 0.1 + 1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None), (998, [1.0])], "id long, embedding array<double>")
    vectorindex.build(df, f"file://{tmp_path}/i", 20)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in vectorindex.search(spark, f"file://{tmp_path}/i", df.where("id % 20 = 0"), 7).orderBy("query", "pos").collect():
        got.setdefault(r.query, []).append(r.id)
    assert got == {q: sorted(range(400), key=lambda j: (-round(float(y[q] @ y[j]), 6), j))[:7] for q in range(0, 400, 20)}
    vectorindex.build(df.limit(0), f"file://{tmp_path}/e")
    assert vectorindex.search(spark, f"file://{tmp_path}/e", df.limit(2), 3).count() == 0


def test_versions_and_documents(spark, tmp_path):
    path = f"file://{tmp_path}/papers"
    row = lambda *r: spark.createDataFrame(list(r), "paper_ref string, n int")
    with pytest.raises(FileNotFoundError):
        store.read_version(spark, path)
    assert store.save(row(("a", 1), ("a", 2), ("b", 1)), path) == 0 and store.save(row(("a", 9)), path) == 1
    assert sorted(tuple(r) for r in store.read_version(spark, path).collect()) == [("a", 9), ("b", 1)]
    (tmp_path / "papers" / "version=000000000007").mkdir()  # an incomplete one
    assert store.versions(spark, path) == [0, 1] and store.get(spark, path, "a").count() == 1 and store.get(spark, path, "c").count() == 0
    assert sorted(r[0] for r in store.list_papers(spark, path).collect()) == ["a", "b"] and store.read_version(spark, path, 0).count() == 3


def test_upsert_of_ties_and_edges(spark):
    df = spark.createDataFrame([("k", 1, "x"), ("k", 1, "y")], "key string, seq int, v string")
    assert {store.upsert(d, ["key"], "seq").first().v for d in (df, df.orderBy(F.desc("v")))} == {"y"}
    x = spark.createDataFrame([("a", "b", "OPEN", "r"), ("a", "b", "OPEN", "s"), ("a", "b", "OPEN", "s"), ("a", "c", "OPEN", None)], "src string, dst string, type string, rel string")
    assert store.upsert_edges(x, spark.createDataFrame([("a",), ("b",)], "node string")).count() == 2


def test_control(spark):
    teams = spark.createDataFrame([("a", "A", None), ("b", "B", "a")], "id string, name string, parent_id string")
    teams = control.put(control.put(teams, {"id": "c", "name": "C", "parent_id": "b"}), {"id": "b", "name": "B2", "parent_id": "a"})
    assert {tuple(r) for r in control.ancestors(teams).collect()} == {("b", "a"), ("c", "b"), ("c", "a")}
    members = control.add(control.add(spark.createDataFrame([], "user_id string, team_id string"), {"user_id": "u", "team_id": "c"}), {"user_id": "u", "team_id": "c"})
    assert [r.team_id for r in control.user_teams(members, "u").collect()] == ["c"]
    users = control.ensure_user(control.ensure_user(spark.createDataFrame([], "id string, name string"), "u"), "u", "other")
    assert [tuple(r) for r in users.collect()] == [("u", "u")]
    assert control.can_access(spark.createDataFrame([("g",)], "id string"), "u", "g") and not control.can_access(spark.createDataFrame([("g",)], "id string"), "u", "h")


def test_judge(spark):
    step = judges.Step("verify", "Is ${statement} so? $$5", "ok boolean, why string", system="for ${who}")
    rows = spark.createDataFrame([(1, "x", "me"), (2, "x", "me"), (3, "fail", "me"), (4, "junk", None)], "request long, statement string, who string")

    def model(systems, prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError
        return ["{" if "junk" in p else '{"ok": true, "why": "' + s + p[-2:] + '"}' for s, p in zip(systems, prompts, strict=True)]

    got = {r.request: r.answer for r in judges.ask(rows, step, model, batch=1).collect()}
    assert tuple(got[1]) == tuple(got[2]) == (True, "for me$5") and got[3] is None and (got[4] is None or got[4].ok is None)
    assert judges.render("${a}-$b", a=1, b=None) == "1-"
    with pytest.raises(KeyError):
        judges.render("${a}")


def test_embedder_tries_again(spark):
    def encode(texts):
        import random

        if random.random() < 0.3:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    embed = judges.embedder(encode, batch=2, prefix="q: ", tries=40)
    got = embed(spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id long, t string"), "t").collect()
    assert {r.id: r.embedding for r in got} == {1: [5.0, 1.0], 2: [3.0, 1.0], 3: [6.0, 1.0]}


def test_concept_layer_from_vectors(spark):
    e = spark.createDataFrame([(f"e{i}", "Material", n, []) for i, n in enumerate(["nickel", "nickel metal", "zinc", "zinc ore", "1 nm at 2 W"])], "uuid string, type string, canonical_name string, aliases array<string>")
    table = {"nickel": [1.0, 0.0, 0.0], "zinc": [0.0, 1.0, 0.0]}
    embed = judges.embedder(lambda ts: [next((v for k, v in table.items() if k in t), [0.0, 0.0, 1.0]) for t in ts])
    items = concepts.vectors_of(e, spark.createDataFrame([("e0", "said of nickel")], "entity string, context string"), embed)
    empty = lambda s: spark.createDataFrame([], s)
    known, placed, up = concepts.layer(e, items, empty("id string, type string, embedding array<double>"), empty("item string, pos int"), empty("item string, concept string"), empty("concept string, other string, rel string"))
    assert {(r.entity, r.concept) for r in placed.collect()} == {("e0", "e0"), ("e1", "e0"), ("e2", "e2"), ("e3", "e2")} and up.count() == 0
    assert {(r.concept, r.name, r.n) for r in known.collect()} == {("e0", "nickel", 2), ("e2", "zinc", 2)}
    nodes, edges = concepts.rows_to_persist(known, placed, up)
    assert {r.definition for r in nodes.collect()} == {"said of nickel", ""} and edges.where("type = 'INSTANCE_OF'").count() == 4


def test_streams(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, at(0), 7, "a", 1.0), (1, at(0), 7, "a", 1.0), (2, at(20), 7, "a", 2.0), (3, at(90), 7, "b", 3.0), (4, at(900), 8, "a", 4.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    rows.write.parquet(f"{tmp_path}/in")
    source = lambda: events.read(spark, f"file://{tmp_path}/in", rows.schema, 100)

    def drained(name, df, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert not events.progress(q)["active"]
        return spark.table(name)

    assert sorted(r.event_id for r in drained("once", events.distinct_events(source()), "append").collect()) == [1, 2, 3, 4]
    assert sorted(tuple(r)[1:] for r in drained("windows", events.trace(source()), "complete").collect()) == [("a", 1, 4.0), ("a", 3, 4.0), ("b", 1, 3.0)]
    assert sorted((r.user_id, r.n) for r in drained("visits", events.sessions(source()), "append").collect()) == [(7, 1), (7, 3)]  # the last one is still open
    assert sorted((r.user_id, r.n) for r in events.sessions(rows).collect()) == [(7, 1), (7, 3), (8, 1)]
    for _ in range(2):  # run again from the start: the same folders
        events.ingest(source(), f"file://{tmp_path}/out", f"{tmp_path}/log{_}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_ingestion_states(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y"), ("b", "")], "paper_ref string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    reading = lambda b: b.select("paper_ref", F.explode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word"))
    events.ingest_documents(source, f"file://{tmp_path}/words", f"file://{tmp_path}/states", f"{tmp_path}/log", reading).awaitTermination()
    assert {(r.paper_ref, r.state, r.n) for r in spark.read.parquet(f"{tmp_path}/states").collect()} == {("a", "done", 2), ("b", "unsupported", 0)}
    bad = events.ingest_documents(source, f"file://{tmp_path}/words", f"file://{tmp_path}/bad", f"{tmp_path}/log2", lambda b: b.select("paper_ref", F.raise_error(F.lit("no")).alias("word")))
    with pytest.raises(Exception, match="no"):
        bad.awaitTermination()
    assert {r.state for r in spark.read.parquet(f"{tmp_path}/bad").collect()} == {"error"}


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for n in ("z.pdf", "b/a.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"12345")
    got = store.scan_files(spark, f"file://{tmp_path}").collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["a.pdf", "z.pdf"] and {r.length for r in got} == {5}
    assert store.scan_files(spark, f"file://{tmp_path}", limit=1).count() == 1
