"""Every operator against plain Python, on texts that are null, empty, blank, long, repeated or tied, with clashing extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import chat, columns, components, embedding, langid, mixing, packing, quality, sharding, simhash, substring, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, fp long, u long, bucket int, size long, start long"


def build(rng):
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "#", " x", "A", "</s>"]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    shared, long = say(40), say(3000)
    texts = [None, "", " \t\n", "one", "Two words", "a b a b a b a b", say(60), say(60).upper(), long, long, f"{say(20)}\n{shared} {say(5)}", f"{say(9)} {shared}\n{say(20)}"]
    texts += [say(int(rng.integers(1, 120))) for _ in range(30)] + [shared] * 6 + ["x\ny\nx\n \nx"]
    sources = ["b", "a", None, "ä", ""]
    return [(i * 3, t, ["en", None, "fr"][i % 3], sources[i % 5], len(t or ""), 1, "k", 2, 3, 4, 5, 6) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return build(np.random.default_rng(3))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_sharding(docs, rows, empty):
    size = columns.F.octet_length(columns.F.coalesce("text", columns.F.lit(""))) + 8
    got = sorted(sharding.shard(docs, "doc_id", size, 4).select("_id", "_size", F.col("_shard").alias("shard"), F.col("_slot").alias("slot")).collect())
    assert [(r[0], r[1]) for r in got] == [(r[0], len((r[1] or "").encode()) + 8) for r in rows]
    total, before = sum(r[1] for r in got), 0
    for r in got:
        assert r.shard == min(3, (2 * before + r[1]) * 4 // (2 * total))
        before += r[1]
    for s in range(4):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(empty, "doc_id", size, 4).count() == 0


def test_sharding_ties(spark):
    df = spark.createDataFrame([(1, 5)] * 7 + [(None, 5)] * 2, "doc_id long, s long")
    got = sharding.shard(df, "doc_id", columns.F.col("s"), 3).collect()
    assert Counter(r._shard for r in got) == {0: 3, 1: 3, 2: 3}


def test_written_shards_hold_every_row_once(spark, docs, rows, tmp_path):
    df = docs.union(docs.limit(1)).unionByName(docs.where("doc_id = 9").withColumn("text", F.lit("other"))).withColumn("shard", F.lit("own")).withColumn("_id", F.lit(1))
    repeated = df.union(df.where("doc_id = 9")).union(df.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    sharding.write_shards(repeated, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 8, 5, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    said = lambda d: Counter(tuple(r) for r in d.collect())
    assert said(back.select(*[c if c != "shard" else "own_shard" for c in repeated.columns])) == said(repeated) and back.select("shard").distinct().count() > 1


@pytest.mark.parametrize("seed", range(5))
def test_packing_boundaries(seed):
    from itertools import combinations

    rng = np.random.default_rng(seed)
    x, c = np.sort(rng.choice(60, 8, replace=False)), rng.integers(1, 9, 8)
    cost = lambda cuts: sum(int(n) * (min(b for b in cuts if b >= v) - v) for v, n in zip(x, c, strict=True))
    for k in (1, 2, 3, 8):
        assert cost(packing.boundaries(x, c, k)) == min(cost([*s, x[-1]]) for q in range(k) for s in combinations(x[:-1], q))


def test_packing_edges_are_lengths_that_occur(spark):
    lengths = [9000, 9001, 20_020, 20_020, 12_345, 5, 8193, None]
    df = spark.createDataFrame([(None if i == 2 else i, n, 7) for i, n in enumerate(lengths)] + [(0, 9000, 7)], "doc_id long, n long, bucket int")
    got = packing.pack(df, F.coalesce("n", F.lit(0)), buckets=3).collect()
    assert {r.bucket_length for r in got} == set(packing.boundaries(np.array([9000, 9001, 20_020, 12_345, 5, 8193, 0]), np.array([2, 1, 2, 1, 1, 1, 1]), 3)) and max(r.bucket_length for r in got) == 20_020
    assert len(got) == 9 and all(r.padding == r.bucket_length - r.length for r in got)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, columns.n_words(columns.F.col("text")), buckets=3, budget=500).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(r[0], len(words(r[1]))) for r in rows]
    batches = {}
    for r in got:
        assert r.length <= r.bucket_length and r.padding == r.bucket_length - r.length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b))) and (len(b) == 1 or sum(r.bucket_length for r in b) <= 500)
    assert packing.pack(empty, columns.n_words(columns.F.col("text"))).count() == 0


def removed(rows, k):
    first = {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None):
        w = words(t)
        for a in range(len(w) - k + 1):
            first.setdefault(tuple(w[a : a + k]), i)
    out = {}
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < r[0]:
                gone[a : a + k] = [True] * k
        out[r[0]] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring(docs, rows, empty):
    want = removed([r for r in rows if r[1] is not None] + [(r[0], "") for r in rows if r[1] is None], 13)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 3000
    back = substring.apply(docs)
    assert back.columns == docs.columns
    for r in back.collect():
        own = rows[r.doc_id // 3]
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else own[1]) and r.source == own[3]
    assert substring.remove_repeats(empty).count() == 0


def test_substring_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([(None, t), (None, t), (4, t), (4, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(0, 15), (0, 15), (4, 0), (4, 0)]


def plain_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def plain_components(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, rows, empty):
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    for k, r in enumerate(rows):
        assert got[r[0]].fp % 2**64 == fps[k] and got[r[0]].component == rows[want[k]][0]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(want))


def test_vantage_tree_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for _ in range(4)]]))
    tree = simhash.VantageTree(fps[::3], 32, 3)
    assert len(tree.nodes) > 8
    met = set()
    for _, own in tree.route(fps):
        for i in range(len(own)):
            close = np.flatnonzero(np.bitwise_count(fps[own[i + 1 :]] ^ fps[own[i]]) <= 3) + i + 1
            met |= {tuple(sorted((int(own[i]), int(own[j])))) for j in close}
    want = {(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1}
    assert met == want and len(want) > 1000


def test_simhash_links_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(2)], np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    fps = fps[np.argsort(fps.view(np.int64))]
    own = [int(f.view(np.int64)) for f in fps]
    found = {r.id: r.component for r in components.components(simhash.link(spark.createDataFrame([(x,) for x in own], "fp long"))).collect()}
    want = plain_components(len(fps), lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 3)
    assert [found.get(x, x) for x in own] == [own[w] for w in want]


def test_simhash_links_lead_over_null_ids(spark, monkeypatch):
    import pyarrow as pa

    known = {"a": 0, "b": 7, "c": 63, "d": 2**40 - 1, None: 1023 << 45}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), pa.array([known[t] for t in b.column(1).to_pylist()], pa.int64())], ["id", "fp"]) for b in bs), "id long, fp long"))
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d"), (9, None), (9, None)], "doc_id long, text string")
    got = sorted(((r.id or 0), r.fp, r.component) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 7, 1), (0, 2**40 - 1, None), (1, 0, 1), (2, 63, 1), (9, 1023 << 45, 9), (9, 1023 << 45, 9)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (30, 3)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 30: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 141)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embedding(spark, monkeypatch):
    monkeypatch.setattr(embedding, "CELL", 40)
    monkeypatch.setattr(embedding, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6)).astype(np.float32)
    x[100:150] = x[:50] + rng.normal(size=(50, 6)).astype(np.float32) * 0.25
    vectors = [(i, [float(v) for v in r], i % 2, "extra", 1) for i, r in enumerate(x)] + [(200 + i, [float(v) for v in x[7]], 1, "e", 2) for i in range(3)]
    odd = [(300, None, 1, "e", 1), (301, [0.0] * 6, 1, "e", 1), (302, [float("nan")] * 6, 1, "e", 1), (303, [1.0, None], 1, "e", 1), (304, [float(v) for v in x[7]], None, "e", 1), (305, [], 1, "e", 1)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, label int, id string, n int")
    got = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    y = np.array([v[1] for v in vectors])
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = lambda i, j: vectors[i][2] == vectors[j][2] and y[i] @ y[j] >= 0.93
    want = plain_components(len(vectors), near)
    for k, v in enumerate(vectors):
        r = got[v[0]]
        assert (r.n_links, r.component_id, r.kept) == (sum(near(k, j) for j in range(len(vectors)) if j != k), vectors[want[k]][0], want[k] == k)
    assert all((got[o[0]].n_links, got[o[0]].component_id, got[o[0]].kept) == (0, o[0], True) for o in odd)
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    named = df.select("vec_id", "embedding", F.concat(F.lit("label "), "label").alias("label")).union(spark.createDataFrame([(None, [1.0] * 6, "label 1")] * 2, "vec_id long, embedding array<float>, label string"))
    again = {r.vec_id: r for r in embedding.near_duplicates(named).collect()}
    assert all(again[k] == r for k, r in got.items()) and tuple(again[None]) == (None, 0, None, True)


def test_embedding_keeps_double_components(spark):
    x = np.array([1.0, 0.0])
    near = np.array([0.93, np.sqrt(1 - 0.93**2)])
    rows = [(0, x.tolist(), 1), (1, (near + [3e-9, 0]).tolist(), 1), (2, (near - [3e-9, 0]).tolist(), 1)]
    got = {r.vec_id: r.component_id for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").where("vec_id <> 1")).collect()}
    assert got == {0: 0, 2: 2}
    assert {r.component_id for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").where("vec_id <> 2")).collect()} == {0}


def test_embedding_cells_hold_small_labels(spark):
    """k-means runs whatever a label's size, and visitors of a cell find all partners."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.2])
    c = embedding.spherical_kmeans(embedding.unit(x), 5)
    met = set()
    for _, rows, home in [(d, set(r.tolist()), h) for d, r, h in embedding.cells(embedding.unit(x), c, 0.93)]:
        if home:
            met |= {(i, j) for i in rows for j in rows if i < j}
            last = rows
        else:
            met |= {tuple(sorted((i, j))) for i in rows for j in last}
    y = embedding.unit(x)
    assert all((i, j) in met for i in range(120) for j in range(i + 1, 120) if y[i] @ y[j] >= 0.93)


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_planes(bits, kind):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 60_000, n).astype(kind)
        sizes, payload = tokens.encode_chunk(ids, 256, bits)
        assert (tokens.decode_chunk(sizes, payload, n, ids.dtype.itemsize, 256, bits) == ids).all()


def test_tokens(spark, docs, rows, empty, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, t = public.path("byte_bpe_50k.json"), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokens.write_tokens(docs, f"file://{tmp_path}/t", path, chunk=500, bits=1)
    start = 0
    for r, own in zip(sorted(tokens.read_tokens(spark, f"file://{tmp_path}/t").collect()), rows, strict=True):
        ids = [*t.encode(own[1] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(np.frombuffer(r.ids, "<u2"))) == (own[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    tokens.write_tokens(empty, f"file://{tmp_path}/e", path)
    assert tokens.read_tokens(spark, f"file://{tmp_path}/e").count() == 0
    rng = np.random.default_rng(0)
    hard = ["".join(rng.choice([*" \n\ta1'.é s　\x1f\x85,᠎​", "<|endoftext|>"], rng.integers(0, 12))) for _ in range(3000)]
    hard += ["".join(rng.choice([*"aZéñßĐɏ×÷ªµ.,!'`~_-9 ", " wörter", "naïve,", "x²", "don't"], rng.integers(0, 9))) for _ in range(3000)] + ["x" * 300, "ab" * 90 + "..."]
    encode = tokens.Encoder(path)
    assert encode.cuts
    for h, got in zip(hard, encode(hard), strict=True):
        assert list(np.frombuffer(got, "<u2")) == t.encode(h, add_special_tokens=False).ids
    assert all(len(p) <= tokens.LONG for p in encode.known)
    other = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    encode = tokens.Encoder(public.path("word_bpe_49k.json"))
    assert not encode.cuts
    for h, got in zip(hard, encode(hard), strict=True):
        assert list(np.frombuffer(got, f"<u{encode.width}")) == other.encode(h, add_special_tokens=False).ids


def test_tokens_of_null_and_repeated_ids(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(None, "b"), (None, "a"), (3, "c"), (3, "c"), (3, None)], "doc_id long, text string")
    tokens.write_tokens(df, f"file://{tmp_path}/n", public.path("byte_bpe_50k.json"))
    got = sorted(tokens.read_tokens(spark, f"file://{tmp_path}/n").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 3, 3] and [r.n_tokens for r in got] == [2, 2, 1, 2, 2]


def plain_targets(sizes):
    """The level at which all is shared, found by stopping sources one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, left, rest = {}, set(order), 1.5 * sum(sizes.values())
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    while left:
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * sizes[s]]
        target |= {s: level * weight[s] for s in left} if not over else {s: 2.0 * sizes[s] for s in over}
        rest, left = (rest - sum(2 * sizes[s] for s in over), left - set(over)) if over else (0, set())
    return target


def test_mixing(docs, rows, empty):
    got = {r._id: r for r in mixing.mix(docs, blocks=200).collect()}
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    target, taken, by_shard = plain_targets(size), Counter(), Counter()
    block = max(1, int(sum(target.values()) // 200))
    for r in rows:
        g = got[r[0]]
        assert (g._size, g._source_size) == (len(words(r[1])), size[r[3]]) and abs(g._target - target[r[3]]) < 1e-6 and 0 <= g._taken <= 2 * g._size
        assert g._taken == sum(x["to"] - x["from"] for x in g._takes) == sum(x["to"] - x["from"] for x in g._parts)
        taken[r[3]] += g._taken
        for x in g._parts:
            by_shard[r[3], x.shard] += x["to"] - x["from"]
    assert all(abs(taken[s] - target[s]) <= 2 * block for s in size)
    assert all(abs(by_shard[s, k] - target[s] / 8) <= 2 * block for s in size for k in range(8))  # each shard in the target's proportions
    assert {r._id: r._taken for r in mixing.mix(docs.repartition(7), blocks=200).collect()} == {k: g._taken for k, g in got.items()}
    made = mixing.apply(docs)
    assert made.columns == docs.columns and sum(len(words(r.text)) for r in made.collect()) == sum(r._taken for r in mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0 and mixing.apply(empty).count() == 0


def test_mixing_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text, "a", 0, 5)] * 5 + [(None, text, "a", 0, 5)] * 3 + [(2, text + " x", None, 0, 5)], "doc_id long, text string, source string, n_chars int, size int")
    planned = mixing.mix(df).collect()
    made = mixing.apply(df)
    assert made.columns == df.columns and len(planned) == 9
    for run in (made, mixing.apply(df.repartition(4))):
        assert sum(len(words(r.text)) for r in run.collect()) == sum(r._taken for r in planned)
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_sainte_lague(spark):
    votes = {"a": 53_000.0, "b": 24_000.0, "c": 23_000.0, "d": 0.0, "e": 500.0}
    houses = spark.createDataFrame([(i, n) for i, n in enumerate((0, 1, 7, 10, 101))], "house long, seats_in_all long")
    got = {}
    for r in mixing.sainte_lague(spark.createDataFrame(list(votes.items()), "k string, v double"), "k", "v", houses).collect():
        got.setdefault(r.house, {})[r.key] = r.seats
    for i, n in enumerate((0, 1, 7, 10, 101)):
        seats = dict.fromkeys(votes, 0)
        for _ in range(n):
            seats[max(sorted(k for k in votes if votes[k]), key=lambda k: votes[k] / (2 * seats[k] + 1))] += 1
        assert got[i] == {k: s for k, s in seats.items() if votes[k]}


def test_language_id(spark):
    rng = np.random.default_rng(2)
    say = lambda lang, n: " ".join(rng.choice({"en": ["the", "and", "with", "thing"], "de": ["der", "und", "nicht", "schön"]}[lang], n))
    data = [(i, say(lang, int(rng.integers(5, 60))), lang) for i in range(120) for lang in ("en", "de")]
    train = spark.createDataFrame([*data, (900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string")
    model = langid.fit(train, 100)
    test = spark.createDataFrame([(1, None), (2, ""), (3, "12 ?! 3"), (4, say("de", 40)), (5, say("en", 5000)), (6, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(test, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "de" and got[5].lang_pred == "en" and got[6].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(train.limit(0)) is None and langid.identify(test, None, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def plain_vector(text, idf):
    """TF-IDF over hashed runs of 1 to 3 characters, by the definition, one character at a time."""
    clean = re.sub(r" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " ")
    codes = [0 if c == " " else ord(c) for c in clean]
    wrap, n = 2**32, Counter()
    for i in range(len(codes)):
        h = 0
        for k, (salt, factor) in enumerate(((0, 2654435761), (0x9E3779B9, 668265263), (0x85EBCA6B, 374761393))):
            if i + k >= len(codes):
                break
            h = codes[i] * 2654435761 % wrap if k == 0 else ((h ^ salt) * factor + codes[i + k] * 2654435761) % wrap
            n[(h ^ h >> 15) % langid.SLOTS] += 1
    v = np.zeros(langid.SLOTS)
    for slot, k in n.items():
        v[slot] = np.log1p(k) * idf[slot]
    return v / np.linalg.norm(v)


def test_language_model_by_its_definition(spark):
    """idf, centroids and cosines against plain arithmetic; letters beyond U+30000, null and repeated ids."""
    rng = np.random.default_rng(12)
    say = lambda kind: "".join(rng.choice([*("abc é." if kind else "xyzñ ,")], 60))
    data = [(None, say(k % 2), "ab"[k % 2]) for k in range(60)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), 400)
    seen = np.zeros(langid.SLOTS)
    for _, t, _ in data:
        seen += plain_vector(t, np.ones(langid.SLOTS)) > 0
    idf = np.log(61 / (1 + seen)) + 0.1
    assert np.allclose(model.idf, idf)
    for lang in "ab":
        own = np.stack([plain_vector(t, idf) for _, t, x in data if x == lang])
        cents = model.centroids[[x == lang for x in model.langs]]
        near = (own @ cents.T).argmax(axis=1)
        for j in set(near):  # each centroid is the mean direction of the texts nearest to it
            mean = own[near == j].sum(axis=0)
            assert mean @ cents[j] / np.linalg.norm(mean) > 0.999
    for text in ("abca cab", "zyx xñz", data[0][1]):
        cos = model.centroids @ plain_vector(text, idf)
        assert model.predict(text)[0] == model.langs[int(cos.argmax())] and abs(model.predict(text)[1] - cos.max()) < 1e-5
    assert model.predict("\U00030001\U00031350")[0] != "und" and model.predict("\U0001F600 12")[0] == "und"
    again = langid.identify(spark.createDataFrame([(None, "abc"), (None, "abc"), (1, None)], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert again[0] == again[1] and again[2].lang_pred == "und"


def test_language_counts_do_not_depend_on_steps(monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice([*"abcÄ ß.\n1"], int(n))) for n in rng.integers(1, 60, 200)]
    whole = [langid.counts(t) for t in texts]
    assert langid.counts("ab " * 500_000).sum() == 3 * 1_500_000 + 1 - 1
    for step in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "STEP", step)
        for t, w in zip(texts, whole, strict=True):
            got = langid.counts(t)
            assert (got is None and w is None) or (got == w).all()


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<~s>", "[~~/INST]", "<s", None, "", "a\nb", "<<s>", "\\n[INST", "]", "~s>", "🙂</s>"]
    rng = np.random.default_rng(4)
    rows = [(c, t, str(rng.choice(["user", "assistant", "system", "to\\ol\n[INST]", "\x00\\n\\\\\n"])), nasty[int(rng.integers(len(nasty)))], 1) for c in range(40) for t in range(int(rng.integers(1, 7)))]
    rows += [(50, None, None, "x", 1), (50, 1, "assistant", "<s>", 1), (50, 1, "assistant", "<s>", 1), (None, 0, "user", "a", 1), (None, 1, "assistant", "\x00", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "loss", chat.parse(columns.F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(t.role, t.text) for t in got[c].turns] == [(o[2], o[3]) for o in own]
        said = [re.sub(r"<~(~*/?s>)", r"<\1", re.sub(r"\[~(~*/?INST\])", r"[\1", got[c].formatted[s.start : s.start + s.length])) for s in got[c].loss]
        assert said == [o[3] for o in own if o[2] == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_quality(docs, rows, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in rows:
        t = r[1] or ""
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (g.base_failed and g.kept)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    clash = docs.withColumn("_h", F.lit("keepme")).withColumn("_id", F.lit(4)).withColumn("_row", F.lit(5)).withColumn("own", F.lit(6)).union(docs.withColumn("a", F.lit("keepme")).withColumn("b", F.lit(4)).withColumn("c", F.lit(5)).withColumn("d", F.lit(6)).where("doc_id = 18"))
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns and all((r._h, r._id, r._row, r.own) == ("keepme", 4, 5, 6) for r in kept.collect())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in got.items() if g.kept for _ in range(1 + (i == 18)))


def test_quality_rejects_outliers(spark):
    rng = np.random.default_rng(8)
    clean = [(i, " ".join("x" * int(n) for n in rng.integers(3, 8, 90)), "en", "s") for i in range(400)]
    noisy = [(1000 + i, " ".join("x" * int(n) + "%%%" for n in rng.integers(3, 8, 90)), "en", "s") for i in range(60)]
    got = quality.judge(spark.createDataFrame([(i, " ".join(f"{w}{k}" for k, w in enumerate(t.split())), lang, s) for i, t, lang, s in clean + noisy], "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_digest_is_of_joined_words(docs):
    r = substring.remove_repeats(docs).where("doc_id = 12").select("text", columns.F.sha2("text", 256).alias("h")).first()
    assert r.h == hashlib.sha256(r.text.encode()).hexdigest()
