"""Sections, pages and chunks: hand-made cases, and what must hold for every document."""

import os

import pytest
from factloom.operators import sections
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_sections(spark):
    rows = [(1, "Front\nAbstract\nx\n1. Intro\ny\nMETHODS\nz"), (2, "only text"), (3, ""), (4, None), (5, "Results\na")]
    got = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", F.explode(sections.sections(F.col("text"))).alias("s")).orderBy("doc_id", "s.start").collect()
    assert [(r.doc_id, *r.s) for r in got] == [(1, 0, 6, "frontmatter", None), (1, 6, 17, "Abstract", "background"), (1, 17, 28, "1. Intro", None), (1, 28, 37, "METHODS", "method"), (2, 0, 9, "body", None), (5, 0, 9, "Results", "result")]


def test_pages_are_half_open(spark):
    pages = sections.page_map(spark.createDataFrame([(1, 1, "abc"), (1, 2, "de"), (2, 1, "")], "doc_id int, page int, text string"))
    offsets = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, 5), (2, 0), (9, 0)], "doc_id int, off int")
    assert {tuple(r) for r in sections.page_of(offsets, pages).collect()} == {(1, 0, 1), (1, 2, 1), (1, 3, 2), (1, 5, None), (2, 0, None), (9, 0, None)}


@pytest.mark.parametrize("text", ["", "a" * 500, "word " * 300, "p one\n\np two\nline\n\n" + "x" * 200, "\n\n\n"])
def test_pieces_keep_all_words_within_the_budget(text):
    got = sections.pieces(text, 10, 0)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert all(len(p) <= 7 * 10 for p in got)  # a word of up to seven characters counts as one token


def test_pieces_overlap():
    words = [f"word{i:03d}" for i in range(60)]
    got = [p.split() for p in sections.pieces(" ".join(words), 12, 4)]
    assert [w for p in got for w in p][0] == "word000" and sorted({w for p in got for w in p}) == words
    assert all(set(a) & set(b) for a, b in zip(got, got[1:]))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_chunks_of_all_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = sections.chunks(docs.withColumn("index", F.lit("a clashing name")), 60, 6).orderBy("doc_id", "index").collect()
    seen = {}
    for r in got:
        assert r["index"] == len(seen.setdefault(r.doc_id, []))
        seen[r.doc_id].append(r)
        assert texts[r.doc_id][r.start : r.end] == r.text and (r.atomic_ref or len(r.text) <= 7 * 60)
    # a part is looked for from the one before on, so a repeated one may be given an earlier place: texts are compared, not places
    whole = sections.chunks(docs, 60, 0).orderBy("doc_id", "index").collect()
    for doc, text in texts.items():
        assert "".join("".join(r.text for r in whole if r.doc_id == doc).split()) == "".join((text or "").split())
