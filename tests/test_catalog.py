"""Every query against its SQL on the smallest tables, and hand-made cases."""

import os

import pandas as pd
import pytest

from factloom.functions import text
from factloom.operators import retrieval, verify
from factloom.plans import catalog
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def norm(df):
    df = df[sorted(df.columns)]
    say = lambda v: None if pd.isna(v) else round(float(v), 6) if not isinstance(v, str) and not hasattr(v, "isoformat") else str(v)
    return sorted([tuple(say(v) for v in row) for row in df.astype(object).values.tolist()], key=repr)


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set memory_limit = '4GB'")
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, oracle, name):
    got, want = catalog.queries()[name](spark, DIR).toPandas(), oracle.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)


def test_relevance_cut(spark):
    rows = [("a", f"x{i}", s) for i, s in enumerate((1.0, 0.9, 0.86, 0.84, 0.5))] + [("b", f"y{i}", s) for i, s in enumerate((1.0, 0.9, 0.88, 0.86, 0.84))]
    got = {(r.sub, r.id) for r in retrieval.relevance_cut(spark.createDataFrame(rows, "sub string, id string, score double")).collect()}
    assert got == {("a", f"x{i}") for i in range(4)} | {("b", f"y{i}") for i in range(4)}


def test_round_robin_and_interleave(spark):
    lists = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "b", 0), (1, "d", 1)], "list int, id string, pos int")
    order = retrieval.round_robin(lists)
    assert [r.id for r in order.orderBy("pos").collect()] == ["a", "b", "d", "c"]
    mixed = retrieval.interleave(order.withColumn("quantified", F.col("id").isin("b", "c")))
    assert [r.id for r in mixed.orderBy("pos").collect()] == ["b", "a", "c", "d"]


def test_pagerank_path(spark):
    edges, seeds = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"), spark.createDataFrame([("a",)], "node string")
    got = {r.node: round(r.score, 6) for r in retrieval.pagerank(edges, seeds, rounds=20).collect()}
    assert got == {"a": 0.354174, "b": 0.441651, "c": 0.204174}


@pytest.mark.parametrize("kernel", [0, retrieval.KERNEL])
def test_pagerank_keeps_its_mass(spark, kernel):
    """Against plain arithmetic, with an isolated seed, a loop, a repeated edge and nodes that no mass reaches; both ways."""
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "a"), ("x", "y"), ("d", "a")]
    edges = spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.score for r in retrieval.pagerank(edges, spark.createDataFrame([("a",), ("lonely",), ("a",)], "node string"), rounds=7, kernel=kernel).collect()}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    score = {"a": 0.5, "lonely": 0.5}
    for _ in range(7):
        new = {s: (0.15 + 0.85 * score.get("lonely", 0)) / 2 for s in ("a", "lonely")}
        for n, s in score.items():
            for m in near.get(n, ()):
                new[m] = new.get(m, 0) + 0.85 * s / len(near[n])
        score = new
    assert set(got) == set(score) and all(abs(got[n] - score[n]) < 1e-12 for n in score) and abs(sum(got.values()) - 1) < 1e-12
    assert retrieval.pagerank(edges, spark.createDataFrame([], "node string"), kernel=kernel).count() == 0


def test_pagerank_ways_agree(spark):
    """In one task, over the nodes of the smaller side, and round by round; with links inside a side, and the first by score."""
    pairs = [(f"f{i}", f"m{i * i % 7}") for i in range(60)] + [(f"f{i}", f"s{i % 3}") for i in range(60)] + [("m1", "s1"), ("m2", "m3"), ("m3", "m2"), ("f1", "f2"), (None, "m1"), ("s0", "s0")]
    edges, seeds = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame([("m1",), ("f3",), ("lonely",)], "node string")
    ways = [dict(), dict(kernel=0), dict(kernel=0, core=1)]
    one, two, three = ({r.node: round(r.score, 12) for r in retrieval.pagerank(edges, seeds, **w).collect()} for w in ways)
    assert one == two == three and abs(sum(one.values()) - 1) < 1e-9
    wanted = spark.createDataFrame([(f"f{i}",) for i in range(60)], "node string")
    best = sorted((-round(s, 7), n) for n, s in one.items() if n[0] == "f")[:5]
    for w in ways:
        got = [(-round(r.score, 7), r.node) for r in retrieval.pagerank(edges, seeds, wanted=wanted, top=5, **w).collect()]
        assert sorted(got)[:5] == best


def test_pagerank_over_core_shuffles_scores_of_one_side_only(spark, monkeypatch):
    """Edges that stay where they are: nothing is dealt round by round."""
    monkeypatch.setattr(retrieval, "_by_rounds", None)
    edges = spark.createDataFrame([(f"f{i}", f"m{i % 9}") for i in range(300)], "a string, b string")
    assert retrieval.pagerank(edges, spark.createDataFrame([("m1",)], "node string"), kernel=0).count() == 35


def test_gate(spark):
    facts = spark.createDataFrame([("1", "unverified"), ("2", "verified"), ("3", "verified"), ("4", "contested"), ("5", "hypothesis")], "uuid string, status string")
    verdicts = spark.createDataFrame([("1", 0.9, 0.8, 0.7), ("2", 0.2, 0.2, 0.2), ("3", 1.0, 1.0, 0.3), ("4", 1.0, 1.0, 1.0)], "uuid string, confidence double, clarity double, relevance double")
    assert [r.status for r in verify.gate(facts, verdicts).orderBy("uuid").collect()] == ["verified", "unverified", "unverified", "contested", "hypothesis"]


def test_language(spark):
    df = spark.createDataFrame([("абв a",), ("a abc б",), ("12",), ("",)], "t string")
    assert [r[0] for r in df.select(text.detect_lang(F.col("t"))).collect()] == ["ru", "en", None, None]
