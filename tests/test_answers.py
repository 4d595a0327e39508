"""Anchors, whole papers, merging, verification and answers on hand-made cases."""

import json
import random

from pyspark.sql import functions as F

from factloom.functions import anchors
from factloom.operators import dedup, papers, retrieval, verify
from factloom.sources import exports


def test_anchors(spark):
    text = "One two\n  three (a+b) four. Two three end 🙂 two three last"
    cases = [("two three", 0, None), ("two  three", 20, None), ("(a+b)", 0, "three end"), ("absent", 0, None), (" ", 0, None), ("one", 0, None), ("two three", 0, "absent"), (None, 0, None), ("two three last", 0, None)]
    df = spark.createDataFrame([(text, *c) for c in cases], "t string, a string, f int, e string")
    got = [None if r[0] is None else text[r[0].start : r[0].end] for r in df.select(anchors.find(F.col("t"), F.col("a"), F.col("f"), F.col("e"))).collect()]
    assert got == ["two\n  three", "two three", "(a+b) four. Two three end", None, None, None, "two\n  three", None, "two three last"]
    checks = spark.createDataFrame([(text, 4, 16, "two three"), (text, 4, 16, "three"), (text, 4, 16, ""), (text, 4, 4, None), (text, -1, 4, None), (text, 4, 1000, None), (None, 0, 1, None)], "t string, s int, e int, a string")
    assert [r[0] for r in checks.select(anchors.verify_span(F.col("t"), F.col("s"), F.col("e"), F.col("a"))).collect()] == [True, False, True, False, False, False, False]


def test_window(spark):
    text = "alpha " + "x" * 2000 + " beta gamma delta " + "y" * 2000
    df = spark.createDataFrame([(text, "alpha BETA gamma"), (text, "none here"), (text, ""), (None, "alpha"), ("", "alpha"), (text, None)], "t string, s string")
    got = [r[0] for r in df.select(anchors.window(F.col("t"), F.col("s"))).collect()]
    at = text.index("beta")
    assert got == [text[at - 350 : at + 350], text[:1200], text[:1200], "", "", text[:1200]]


def test_assemble(spark):
    rows = [("p", 0, "text", " intro "), ("p", 1, "title", "1  Methods"), ("p", 2, "table", "a b"), ("p", 3, "text", "  "), ("p", 4, "title", "Results"), ("q", 0, "text", "alone"), ("r", 0, "text", " "), ("s", 0, "title", "Results"), ("s", 1, "text", None)]
    df = spark.createDataFrame(rows, "paper_ref string, n int, category string, text string")
    raw = {r.paper_ref: r.raw_text for r in papers.assemble_text(df).collect()}
    assert raw == {"p": "intro\n1  Methods\na b\nResults", "q": "alone", "s": "Results"}
    got = {(r.paper_ref, r.sec_id, r.name, r.start, r.end) for r in papers.assemble_sections(df).collect()}
    assert got == {("p", "sec-0", "frontmatter", 0, 6), ("p", "sec-1", "1 Methods", 6, 21), ("p", "sec-2", "Results", 21, 28), ("q", "sec-0", "body", 0, 5), ("r", "sec-0", "body", 0, 0), ("s", "sec-0", "Results", 0, 7)}
    assert [tuple(r) for r in papers.assemble_tables(df).collect()] == [("p", "tbl-0", "a b", 17, 20)]


def test_load(spark):
    text = "Abstract\nwe did\nTable 1 shows\nMethods\nmore\nResults\nyes\nReferences\n[1] Some paper\nnot one\n2. Other"
    r = papers.load(spark.createDataFrame([("p", "p.pdf", text, 2), ("q", None, None, None)], "paper_ref string, source string, text string, n_pages int")).orderBy("paper_ref").collect()
    assert [x.raw for x in r[0].parsed.refs] == ["[1] Some paper", "2. Other"] and [x.caption for x in r[0].parsed.tables] == ["Table 1 shows"]
    assert r[0].meta.structure_reliable and r[0].title == "" and r[0].year is None and r[0].meta.n_chars == len(text)
    assert r[1].raw_text == "" and r[1].parsed.sections == [] and not r[1].meta.structure_reliable


def test_near_merge(spark):
    rng, rows = random.Random(1), []
    for grp in range(20):
        for pos in range(rng.randrange(1, 15)):
            a, b = rng.sample("abcdefgh", 2)
            rows.append((grp, pos, a, b))
    want = set()
    for grp in range(20):
        remap, gone = {}, set()
        for _, _, a, b in sorted(r for r in rows if r[0] == grp):
            if a not in gone and b not in gone:
                remap = {k: a if v == b else v for k, v in remap.items()} | {b: a}
                gone.add(b)
        want |= {(grp, k, v) for k, v in remap.items()}
    got = dedup.near_merge(spark.createDataFrame(rows, "grp int, pos int, a string, b string"))
    assert {tuple(r) for r in got.collect()} == want
    assert dedup.near_merge(spark.createDataFrame([], "grp int, pos int, a string, b string")).count() == 0


def test_verify_on_read(spark):
    facts = spark.createDataFrame([(f"{i:02}", "p", f"statement {i}", "1 unit", "unverified", i == 3, "text") for i in range(30)], "uuid string, paper_ref string, statement string, q_raw string, status string, v_checked boolean, source string")
    evidence = facts.select("uuid", F.col("uuid").cast("int").alias("pos"))
    passages = spark.createDataFrame([("01", "passage")], "uuid string, source string")
    asked = verify.requests(facts, evidence, passages, spark.createDataFrame([("p", "whole text")], "paper_ref string, text string"))
    got = {r.uuid: r.source for r in asked.collect()}
    assert sorted(got) == [f"{i:02}" for i in range(21) if i != 3] and got["01"] == "passage" and got["02"] == "whole text"
    verdicts = spark.createDataFrame([("01", 0.9, 0.8, 0.7, "r" * 500), ("02", 1.0, 1.0, 0.3, None), ("29", 1.0, 1.0, 1.0, "late")], "uuid string, confidence double, clarity double, relevance double, rationale string")
    done = verify.settle(asked, verdicts)
    assert {(r.uuid, r.status, r.conf, len(r.rationale)) for r in done.collect()} == {("01", "verified", 0.8, 400), ("02", "unverified", 0.767, 0)}
    after = {r.uuid: r.v_checked for r in verify.apply(facts, done).collect()}
    assert after["01"] and after["02"] and not after["04"]


def test_decompose_and_discover(spark):
    q = spark.createDataFrame([("q", [" a ", "", " ", "b"]), ("r", ["", None]), ("s", None), ("t", list("abcdefgh"))], "question string, subs array<string>")
    assert [r.subs for r in retrieval.decompose(q).orderBy("question").collect()] == [["a", "b"], ["r"], ["s"], list("abcdef")]
    feed = spark.createDataFrame([(0, "", None, 2000), (1, "Known title", [], 2001), (2, "New one", [("A", "B"), (None, None), (None, "C"), ("D", "E")], None), (3, "Newer", None, 2003)], "pos int, title string, authors array<struct<given:string,family:string>>, year int")
    none = F.lit(None).cast("string")
    got = retrieval.discover(feed.select("*", none.alias("venue"), none.alias("doi"), none.alias("url")), spark.createDataFrame([("The known title of all",)], "title string"), 2)
    assert [(r.title, r.authors) for r in got.orderBy("pos").collect()] == [("New one", "A B, C"), ("Newer", "")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "chunk", 1.5), ("p", "link", None)], "paper string, stage string, took double")
    exports.fan_out(rows, [exports.null_sink, exports.jsonl_sink(f"file://{tmp_path}/t", "stage"), exports.table_sink(f"file://{tmp_path}/p")])
    lines = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/t").collect()]
    assert sorted(x["stage"] for x in lines) == ["chunk", "link"] and {x["_coll"] for x in lines} == {"stage"}
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/p")
    exports.stream_out(stream, [exports.table_sink(f"file://{tmp_path}/o")], f"file://{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/o").count() == 2
