"""Every registered corpus query and the pipeline, against SQL or plain code, on the smallest tables and on a hand-made one."""

import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from factloom.llm import registry

DIR = "/root/testdata/sf0.001"
ORACLES = registry.ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}
QUERIES = registry.QUERIES | {"pipeline": corpus_pipeline.run}
TYPES = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op6_token_output": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "shards": "string"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double", "rejected": "boolean"},
    "op9_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}


def norm(df):
    df = df[sorted(df.columns)]
    say = lambda v: None if pd.isna(v) else round(float(v), 6) if not isinstance(v, str) else v
    return sorted([tuple(say(v) for v in row) for row in df.astype(object).values.tolist()], key=repr)


def views(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    return con


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    """Documents that are null, empty, blank, long, tied, copies and near copies, with symbols and lines that repeat; null sources and languages."""
    rng = np.random.default_rng(21)
    vocabulary = [f"{'xyzuv'[i % 5] * (1 + i % 7)}{i}" for i in range(900)] + ["é", "#", "Ä", "B"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    shared, texts = say(60), [None, "", " \t\n", "one", "Two words", "a b " * 40, say(9000)]
    texts += [say(int(rng.integers(40, 400))) for _ in range(150)]
    for t in texts[10:50]:
        w = t.split()
        w[int(rng.integers(len(w)))] = "changed"
        texts += [" ".join(w), t.upper()] if rng.random() < 0.5 else [t, t]
    texts += [f"{say(70)}\n{shared} {say(30)}" for _ in range(30)] + ["\n".join([say(20)] * 5 + [say(80)]), say(80) + " %%%%" * 30, say(60) + "\n" + "$ " * 50]
    pick = lambda k, xs: [xs[i % len(xs)] for i in range(k)]
    n = len(texts)
    folder = tmp_path_factory.mktemp("hard")
    table = {"doc_id": (rng.permutation(n) * 7).tolist(), "text": texts, "lang": pick(n, ["en", "de", None]), "source": pick(n, ["b", "a", "ä", None, ""]), "n_chars": [len(t or "") for t in texts]}
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table(table, kinds), f"{folder}/documents.parquet")
    return str(folder)


def same(spark, name, folder):
    got = QUERIES[name](spark, folder)
    if name in TYPES:
        assert dict(got.dtypes) == TYPES[name]
    got, want = got.toPandas(), views(folder).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)
    return got


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same(spark, name, DIR)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op5_embedding_dedup", "op9_chat_formatting"}))
def test_query_on_hard_rows(spark, hard, name):
    got = same(spark, name, hard)
    if name == "op10_quality_rules":
        assert (~got.kept & ~got.base_failed).sum() >= 2 and got.kept.sum() > 150
    if name == "op4_simhash_dedup":
        assert (got.component_id != got.doc_id).sum() > 30


def test_stages_return_the_columns_of_documents(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    con, before = views(hard), docs
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "mixing", "packing"]
    for (name, stage), sql in zip(corpus_pipeline.STAGES[:-1], (corpus_pipeline.quality.APPLY_SQL, corpus_pipeline.nearcopies.APPLY_SQL, corpus_pipeline.substring.APPLY_SQL, corpus_pipeline.mixing.APPLY_SQL), strict=True):
        out = stage(spark, before, hard)
        assert out.schema == docs.schema
        got, want = out.drop("n_chars").toPandas(), con.execute(sql).df()
        assert norm(got) == norm(want), name
        assert out.where("n_chars <> char_length(coalesce(text, ''))").count() == 0
        con.execute(f"create table after_{name} as {sql}")
        con.execute(f"create or replace view documents as select * from after_{name}")
        before = spark.createDataFrame(out.collect(), docs.schema)


@pytest.mark.parametrize("folder", ["hard", DIR])
def test_token_output(spark, hard, folder):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    folder = hard if folder == "hard" else folder
    t, start = Tokenizer.from_file(public.path("byte_bpe_50k.json")), 0
    got = QUERIES["op6_token_output"](spark, folder)
    assert dict(got.dtypes) == TYPES["op6_token_output"]
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    for r, own in zip(sorted(got.collect(), key=lambda r: r.doc_id), docs, strict=True):
        ids = [*t.encode(own.text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (own.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_language_id_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, folder)
    assert dict(got.dtypes) == TYPES["op8_language_id"]
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = []
    for r in rows:
        own = docs[r.doc_id]
        letters = any(c.isalpha() for c in own.text or "")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not letters)
        if r.held_out and letters and own.lang is not None and len(re.findall(r"\S+", own.text)) >= 10:
            right.append(r.lang_pred == own.lang)
    assert len(right) > 100 and np.mean(right) > 0.97
