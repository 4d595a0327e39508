"""Hand-made cases of the text, extraction, resolution and concept operators."""

from pyspark.sql import functions as F

from factloom.operators import analytics, concepts, extraction, resolution, structure


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_regions_clip_and_overlap(spark):
    one = spark.range(1).select(structure.regions(F.lit(0), F.lit(10), F.expr("array(named_struct('start', 4, 'end', 20, 'ref', 'b'), named_struct('start', 2, 'end', 6, 'ref', 'a'))")).alias("r")).first().r
    assert [tuple(x) for x in one] == [(0, 2, None), (2, 6, "a"), (6, 10, "b")]
    assert [tuple(x) for x in spark.range(1).select(structure.regions(F.lit(0), F.lit(3), F.expr("cast(array() as array<struct<start:int,end:int,ref:string>>)")).alias("r")).first().r] == [(0, 3, None)]


def test_captions(spark):
    docs = spark.createDataFrame([(1, "x\n Table 1 A\nsee Table 2\nTABLE 3"), (2, ""), (3, None)], "doc_id int, text string")
    assert [(r.ref, r.start, r.caption) for r in structure.captions(docs, structure.TABLE, "tbl").orderBy("start").collect()] == [("tbl-0", 2, "Table 1 A"), ("tbl-1", 25, "TABLE 3")]


def test_references_follow_their_heading(spark):
    docs = spark.createDataFrame([(1, "[9] no\nReferences\n[1] A. B.\nnone\n 2. C"), (2, "[1] x"), (3, None)], "doc_id int, text string")
    assert pairs(structure.references(docs).select("ref", "raw")) == {("ref-0", "[1] A. B."), ("ref-1", "2. C")}


def test_frames_without_anything(spark):
    kind = "chunk string, ord string, paper_ref string, frame_type string, slots map<string,string>, about array<struct<mention:string,type:string>>, open_edges array<struct<src:string,rel:string,dst:string>>, statement string, negated boolean"
    row = extraction.clean(spark.createDataFrame([("c", "0", "p", "Odd", {"material": " "}, [(None, "Material"), ("x", "Odd")], [("a", " ", "b")], None, None)], kind))
    got = row.first()
    assert (got.frame_type, got.slots, got.about, got.open_edges, got.statement, got.negated) == ("ClaimFact", {}, [], [], "", False)
    facts, entities, edges = extraction.build(row.withColumn("statement", F.lit("a b c d e f g h i")))
    assert facts.first().anchor == "a b c d e f g h" and entities.isEmpty() and edges.isEmpty()


def test_merges_need_two_and_ignore_blanks(spark):
    e = spark.createDataFrame([("t", "a", "A", ["x"]), ("t", "b", "B", ["A"]), ("t", "c", "C", [])], "grp string, uuid string, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame([("t", 1, 0, "A"), ("t", 1, 1, " "), ("t", 1, 2, "A"), ("t", 2, 0, "B"), ("t", 2, 1, "x"), ("t", 2, 2, "no")], "grp string, cluster int, pos int, name string")
    assert pairs(resolution.merges(e, asked)) == {("a", "b")}


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.range(n + 2).select(F.col("id").alias("node"))
    assert pairs(concepts.components(nodes, spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))) == {(i, 0) for i in range(n + 1)} | {(n + 1, n + 1)}


def test_place_keeps_the_taxonomy_without_cycles(spark):
    kind = "child string, parent string"
    there = spark.createDataFrame([("a", "b"), ("b", "c")], kind)
    wanted = spark.createDataFrame([("c", "a"), ("d", "e"), ("e", "d"), ("d", "a"), ("e", "e")], kind)
    assert pairs(concepts.place(there, wanted)) == {("d", "e"), ("d", "a")}
    assert pairs(concepts.closure(spark.createDataFrame([("x", "y"), ("y", "x")], kind))) == {(a, b) for a in "xy" for b in "xy"}
    assert pairs(concepts.reduce(spark.createDataFrame([("b", "pp")], kind), spark.createDataFrame([("b", "ep"), ("ep", "pp")], kind))) == {("b", "ep"), ("ep", "pp")}


def test_maturity_pools_three_contexts(spark):
    rows = [("a", i, c) for i, c in enumerate(["heat", None, "heat", "cold"])] + [("b", 0, "one"), ("b", 1, "two")]
    assert pairs(concepts.maturity(spark.createDataFrame(rows, "concept string, seq int, context string"))) == {("a", 4, "heat", True), ("b", 2, "one | two", False)}


def test_compare_drops_empty_rows(spark):
    props = spark.createDataFrame([("x", "name", "X"), ("y", "name", "Y"), ("y", "zeta", "1"), ("x", "kind", ""), ("z", "name", "Z")], "node string, key string, value string")
    assert [tuple(r) for r in analytics.compare(props, ["x", "y"], ["name", "kind"]).orderBy("pos").collect()] == [("name", "X", "Y", 1), ("zeta", None, "1", 3)]
