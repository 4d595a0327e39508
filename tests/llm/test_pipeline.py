"""The pipeline's stages against plain Python."""

import numpy as np

import corpus_pipeline
from factloom.llm import columns, nearcopies, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(texts):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def near_rows(seed, n=40):
    rng = np.random.default_rng(seed)
    say = lambda k: [f"w{i}" for i in rng.integers(0, 3000, k)]
    passage, texts = say(60), [None, "", "one two", "one two"]
    for _ in range(n):
        base = say(int(rng.integers(50, 300)))
        texts.append(" ".join(base))
        for edits in rng.integers(0, 10, 3):
            w = list(base)
            for at in rng.integers(0, len(w), max(1, int(edits) * len(w) // 200)):
                w[at] = "changed"
            texts.append(" ".join(w))
        texts.append(" ".join(say(150) + passage))
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_near_copies_of_similarity_from_0_8(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "COMMON", 3)
    rows = near_rows(4)
    want = groups([r[1] for r in rows])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for block in (1024, 2):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        got = corpus_pipeline.simhash_dedup(spark, df, "")
        assert got.columns == df.columns
        assert sorted(tuple(r) for r in got.collect()) == sorted(r for i, r in enumerate(rows) if want[i] == i)
    assert 60 < len(set(want)) < 160


def test_quality_estimates_decide(spark):
    """Each statistic alone rejects what lies far outside its group's spread, and the base rules pass."""
    rng = np.random.default_rng(8)
    say = lambda at, k=200, wide=0: [f"{'x' * (int(n) + wide)}{at:04d}q{i}" for i, n in enumerate(rng.integers(3, 8, k))]
    rows = [(i, " ".join(say(i)), "en", "s", 0) for i in range(400)]
    for i in range(1000, 1010):
        w = say(i)
        rows.append((i, " ".join(say(i, wide=4)), "en", "s", 0))
        rows.append((i + 100, " ".join(w[:160] + w[:40]), "en", "s", 0))
        rows.append((i + 200, "\n".join(w + ["x" * 8] * 16), "en", "s", 0))
        rows.append((i + 300, " ".join(w[:-1] + [w[-1] + "%"]), "en", "s", 0))  # one symbol is within the resolution
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(r.kept == (i < 1000 or i >= 1300) for i, r in got.items())


def test_near_copies_keep_one_row_for_null_and_repeated_ids(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(70)) for c in "tu")
    df = spark.createDataFrame([(None, t, "en", "s", 1), (None, t, "en", "s", 1), (5, t, "en", "s", 1), (5, t, "en", "s", 1), (5, u, "en", "s", 1), (None, u + " x", "en", "s", 1)], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()) == [(5, t), (5, u)]
    nulls = df.where("doc_id is null")
    assert sorted(r.text for r in corpus_pipeline.simhash_dedup(spark, nulls, "").collect()) == [t, u + " x"]
    assert corpus_pipeline.simhash_dedup(spark, df.limit(0), "").count() == 0


def test_simhash_deduplicate_keeps_one_row_for_null_and_repeated_ids(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(70)) for c in "tu")
    df = spark.createDataFrame([(None, t, "en", "s", 1), (None, t, "en", "s", 1), (5, t, "en", "s", 1), (5, t, "en", "s", 1), (None, u, "en", "s", 1), (None, u, "en", "s", 1)], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in simhash.deduplicate(df).collect()) == [(0, u), (5, t)]


CLASH = ["_id", "_h", "_row", "row", "k", "t", "batch", "h", "id", "size", "_text", "_take", "component", "key", "own", "kept", "length", "bucket"]


def test_stages_keep_columns_that_clash(spark):
    """Extra columns with the operators' own names come out as they went in; null ids, texts and sources and repeated rows pass."""
    say = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(i if i % 7 else None, say(f"w{i}x", 60 + i % 5) if i % 11 else None, None if i % 3 else "en", None if i % 4 else "s", 5) for i in range(1, 45)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], SCHEMA)
    for n, c in enumerate(CLASH):
        docs = docs.withColumn(c, columns.F.concat(columns.F.lit(f"{n}-"), columns.F.coalesce("doc_id", columns.F.lit(-1))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) > 20 and all(r[c] == f"{n}-{-1 if r.doc_id is None else r.doc_id}" for r in got for n, c in enumerate(CLASH)), name
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 46


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Candidates come from SimHash fingerprints alone: where none is within the radius, only copies go."""
    t = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate([t, t[:-1] + ["x"], t, t[:8], t[:9], t[50:]])]
    docs = spark.createDataFrame(rows, SCHEMA)
    for radius, want in ((nearcopies.RADIUS, [0, 3, 5]), (-1, [0, 1, 3, 4, 5])):
        monkeypatch.setattr(nearcopies, "RADIUS", radius)
        assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == want


def test_copy_tree_deals_out_every_pair():
    """Linked pairs meet in a leaf of the tree, over sizes and over points, and each block or pair of blocks links them."""
    rng = np.random.default_rng(3)
    base = np.concatenate([np.repeat(rng.integers(0, 2**63, (1, 8), dtype=np.uint64), 150, axis=0), np.repeat(rng.integers(0, 2**63, (150, 8), dtype=np.uint64), 2, axis=0)])
    flips = np.packbits(rng.random((450, 512)) < np.where(np.arange(450) < 150, 0.02, rng.choice([0.02, 0.1, 0.2], 450))[:, None], axis=1).view(np.uint64)
    n = np.concatenate([rng.integers(80, 100, 150), np.repeat(np.exp(rng.uniform(1.5, 7, 150)).astype(int), 2) + rng.integers(0, 2, 300)])
    items = np.concatenate([n.view(np.uint64)[:, None], base ^ flips], axis=1)
    link = lambda i, j: 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]) and nearcopies.distances(items[i : i + 1, 1:], items[j, 1:])[0] <= nearcopies.RADIUS
    want = {(i, j) for j in range(450) for i in range(j) if link(i, j)}
    tree = nearcopies.CopyTree(items, nearcopies.RADIUS)
    assert {p is None for p, _ in tree.nodes.values()} == {True, False}
    leaves = [set() for _ in items]
    for leaf, own in tree.route(items):
        for i in own:
            leaves[i].add(leaf)
    assert len(want) > 5000 and all(leaves[i] & leaves[j] for i, j in want)
    for block in (np.zeros(450, int), rng.integers(0, 2, 450)):
        root = nearcopies.forest(items, block, nearcopies.RADIUS)
        assert all(root[i] == root[j] for i, j in want if block.max() == 0 or block[i] != block[j])
        assert len(set(root)) > 100


def test_rows_that_meet_grow_with_the_texts(spark, monkeypatch):
    """Four times the texts, unrelated but for a few copies and a passage, are about four times the rows that are dealt out to be compared."""
    for name in ("CELL", "MOST_CELL"):
        monkeypatch.setattr(nearcopies, name, 64, raising=False)
    dealt = []
    frame, grouped = type(spark.range(1)), type(spark.range(1).groupBy("id"))
    for kind, name, rows in ((frame, "mapInArrow", lambda x: x), (grouped, "applyInArrow", lambda x: x._df)):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), rows=rows, **b: dealt.append(rows(self).count()) or f(self, *a, **b))
    rng, totals = np.random.default_rng(5), []
    for n in (200, 800):
        texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 60)) for _ in range(n)]
        texts = [t + " the same words end every tenth text" * (i % 10 == 0) for i, t in enumerate(texts)] + [t + " x" for t in texts[: n // 20]]
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
        dealt.clear()
        assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").select("doc_id").collect()) == list(range(n))
        totals.append(sum(dealt))
    assert totals[1] <= 5 * totals[0], totals


def test_large_buckets_link_as_small_ones(spark, monkeypatch):
    """Buckets of any size give the links of plain code: copies of one text, and texts that share most but not enough."""
    monkeypatch.setattr(nearcopies, "COMMON", 3)
    rng = np.random.default_rng(6)
    base, texts = [f"b{i}" for i in range(100)], []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 100, int(rng.integers(0, 3))):
            w[at] = f"c{i}"
        texts.append(" ".join(w))
        texts.append(" ".join(base[:60] + [f"d{i}x{k}" for k in range(20)]))  # 56 of its 76 shingles are the passage's
        texts.append(texts[-1] + " end")
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want, large = groups(texts), []
    monkeypatch.setattr(nearcopies, "_link_large", lambda b, r, f=nearcopies._link_large: large.append(b.count()) or f(b, r))
    for cell in (4096, 8):
        monkeypatch.setattr(nearcopies, "CELL", cell)
        got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
        assert sorted(r.doc_id for r in got) == [i for i, g in enumerate(want) if g == i]
    assert len(large) == 1 and large[0] > 1000 and 60 < len(set(want)) < 120


def test_similar_sets_share_a_sample():
    """Sets of similarity 0.8 share a sample in the share of orders that README states, of any size; unrelated ones share none."""
    rng = np.random.default_rng(7)
    for union in (5, 10, 50, 400, 9000):
        differ, equal = union // 5, []
        for _ in range(200 if union < 1000 else 5):
            u = rng.integers(0, 2**64, union, dtype=np.uint64)
            a, b = np.sort(u[differ // 2 :]), np.sort(u[: union - (differ - differ // 2)])
            mine, its = nearcopies.samples(a), nearcopies.samples(b)
            equal.append(len(np.intersect1d(mine, its)) / nearcopies.ORDERS)
            assert equal[-1] > 0 and not np.intersect1d(mine, nearcopies.samples(~a)).size
        assert union == 5 or abs(np.mean(equal) - 0.5) < 0.15
    assert not nearcopies.samples(rng.integers(0, 2**64, 3, dtype=np.uint64)).size
