"""Near copies by words: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm.components import components
from factloom.llm.rows import first_of_each, mark
from factloom.llm.simhash import VantageTree

SHINGLE, SEED = 5, 42
#: Fingerprints of 64 * WORDS bits link at RADIUS differing bits, of which FIRST_RADIUS at most are in the first two words and
#: NEXT_RADIUS at most in the first three. At similarity 0.8 a bit differs with probability 0.15: 78 bits of 512, with a deviation of
#: 8.1; 19.4 of 128, with 4.1; 29 of 192, with 5.0. Four shingles in a set of five are the worst case with 0.1875.
WORDS, RADIUS, FIRST_RADIUS, NEXT_RADIUS = 8, 160, 52, 70
#: Orders of shingles, each of which gives a sample fingerprint, and the smallest set that a different one can be similar to. At similarity
#: 0.8 a sample is equal with probability 0.51; four shingles in a set of five are the worst case with 0.4, and 0.6 ** 40 is 1.3e-9.
ORDERS, LEAST = 40, 4
#: Fingerprints that shape the tree, those that a side of its node must at least hold, points tried for a node, the share of
#: pairs that a node may leave, and levels. They set cost, not results.
SAMPLE, COMMON, TRIES, GAIN, LEVELS = 8192, 8, 32, 0.75, 16
#: Rows of a bucket that are compared in one piece; larger buckets go over the tree and are cut into blocks of so many.
CELL = 4096
#: Sets and shingles in a block; larger candidate groups are cut into blocks that meet pair by pair.
BLOCK, BLOCK_SHINGLES = 1024, 2**21


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of all k-word shingles in order, words as in SimHash; of all words where these are k at most."""
    words = (text or b"").lower().split()
    one, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(one, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    return np.unique(np.array([h(one[i:j], SEED) for i, j in zip((ends - lens)[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def mixed(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    x = hashes + salts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of 64 * WORDS bits: each is set if it is in over half of the shingles' hashes, mixed anew for each word."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(hashes), 255):
        ones += np.unpackbits(mixed(hashes[i : i + 255, None], np.arange(WORDS)).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)  # 255 at most
    return np.packbits(2 * ones > len(hashes)).tobytes()


def samples(hashes: np.ndarray) -> np.ndarray:
    """The distinct SimHash fingerprints, 64 bits each, of the three shingles that come first in each of ORDERS orders (MinHash's).

    Sets with few differences draw the same three in many orders, so their samples' fingerprints are equal there. A set of
    less than LEAST shingles is similar to none but itself and has no samples.
    """
    if len(hashes) < LEAST:
        return np.zeros(0, np.uint64)
    salts = np.arange(WORDS, WORDS + ORDERS)[:, None]

    def first(h: np.ndarray) -> np.ndarray:
        at = np.argpartition(mixed(h, salts), 2, axis=1)[:, :3]
        return np.take_along_axis(np.broadcast_to(h, (ORDERS, h.shape[1])), at, axis=1)

    parts = [first(h[None]) for h in np.array_split(hashes, -(-len(hashes) // 4096))]
    a, b, c = (parts[0] if len(parts) == 1 else first(np.concatenate(parts, axis=1))).T
    return np.unique((a & b) | (b & c) | (a & c))  # a bit is set if it is in over half of three


def distances(fps: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ point).sum(axis=1, dtype=np.int64)


class CopyTree(VantageTree):
    """The vantage-point tree over fingerprints and sizes of a bucket's sets, rows (n, words). Each node splits by the Hamming distance to a
    point or, as sets of similarity 0.8 have sizes within a fifth, by size, the distance to the empty set (point None).

    Both sides of a node overlap by the radius, so every pair that may link meets in a leaf. Hardly any point tells unrelated
    texts apart at this radius; a node is made only where its sides leave GAIN of a sample's pairs, by points in large groups of copies and by sizes.
    """

    def __init__(self, sample: np.ndarray, radius: int):
        self.radius, self.nodes = radius, {}
        self._build(sample, 1, LEVELS)

    def sides(self, items: np.ndarray, point: np.ndarray | None, median: int) -> tuple[np.ndarray, np.ndarray]:
        if point is None:
            n = items[:, 0].view(np.int64)
            return n <= median, 5 * n > 4 * median
        d = distances(items[:, 1:], point)
        return d <= median, d > median - self.radius

    def _best(self, values: np.ndarray, reach: Callable[[np.ndarray], np.ndarray]) -> tuple[float, int]:
        """The median that leaves least pairs; reach(medians): the values up to which items are inside only."""
        values, medians = np.sort(values), np.unique(values)
        inside = np.searchsorted(values, medians, "right")
        outside = len(values) - np.searchsorted(values, reach(medians), "right")
        pairs = np.where((inside < COMMON) | (outside < COMMON), np.inf, inside.astype(float) ** 2 + outside.astype(float) ** 2)
        k = int(np.argmin(pairs))
        return float(pairs[k]), int(medians[k])

    def _build(self, items: np.ndarray, at: int, depth: int) -> None:
        if not depth or len(items) < 2 * COMMON:
            return
        best = [(*self._best(items[:, 0].view(np.int64), lambda m: 4 * m // 5), None)]
        for point in items[:: max(1, len(items) // TRIES)][:TRIES, 1:]:
            best.append((*self._best(distances(items[:, 1:], point), lambda m: m - self.radius), point))
        pairs, median, point = min(best, key=lambda x: x[0])
        if pairs > GAIN * len(items) ** 2:
            return
        self.nodes[at] = (point, median)
        for side, rows in enumerate(self.sides(items, point, median)):
            self._build(items[rows], 2 * at + side, depth - 1)


def star(n: int, close: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n items, the first that its component reaches; close(i, js) tells which of js item i links."""
    root, left = np.arange(n), np.arange(n)
    while len(left):
        first, queue = left[0], [left[0]]
        left = left[1:]
        while queue and len(left):
            hit = close(queue.pop(), left)
            found, left = left[hit], left[~hit]
            root[found] = first
            queue.extend(found.tolist())
    return root


def _items(n: pa.ChunkedArray | pa.Array, fp: pa.ChunkedArray | pa.Array) -> np.ndarray:
    words = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(-1, WORDS)
    return np.concatenate([np.asarray(n, np.int64).view(np.uint64)[:, None], words], axis=1)


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of rows b may be similar to rows a, or to one row a, by size, the first words and all words."""
    n, m = a[..., 0].view(np.int64), b[:, 0].view(np.int64)
    bits = np.cumsum(np.bitwise_count(a[..., 1:4] ^ b[:, 1:4]), axis=1, dtype=np.int64)
    may = (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (bits[:, 1] <= FIRST_RADIUS) & (bits[:, 2] <= NEXT_RADIUS)
    at = np.flatnonzero(may)
    may[at] = np.bitwise_count((a if a.ndim == 1 else a[at])[..., 1:] ^ b[at, 1:]).sum(axis=1, dtype=np.int64) <= radius
    return may


def forest(items: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
    """For items (n, words) of one block, or of two that meet, the first that each one's component reaches within the radius."""
    order = np.lexsort((items[:, 0].view(np.int64), block))
    cut = int(np.searchsorted(block[order], block.max()))  # 0: one block meets itself
    near, n = np.zeros(len(items), bool), items[order, 0].view(np.int64)
    one, two, three = (np.ascontiguousarray(items[order, k]) for k in (1, 2, 3))
    for i in range(0, cut or len(items), 32):
        own = slice(i, min(i + 32, cut or len(items)))
        low = cut + int(np.searchsorted(5 * n[cut:], 4 * n[own][0])) if cut else i
        high = cut + int(np.searchsorted(4 * n[cut:], 5 * n[own][-1], "right"))
        for j in range(low, high, 4096):
            to = slice(j, min(j + 4096, high))
            bits = np.bitwise_count(one[own, None] ^ one[None, to]) + np.bitwise_count(two[own, None] ^ two[None, to])
            u, v = np.divmod(np.flatnonzero(bits <= FIRST_RADIUS), bits.shape[1])
            all_three = bits[u, v] + np.bitwise_count(three[u + i] ^ three[v + j])
            u, v = u[all_three <= NEXT_RADIUS] + i, v[all_three <= NEXT_RADIUS] + j
            fresh = ~(near[u] & near[v]) & ((u < v) | (cut > 0))
            if fresh.any():
                u, v = u[fresh], v[fresh]
                hit = _linked(items[order[u]], items[order[v]], radius)
                near[u[hit]] = near[v[hit]] = True
    linked = order[near]
    own, root = items[linked], np.arange(len(items))
    root[linked] = linked[star(len(linked), lambda i, js: _linked(own[i], own[js], radius))]
    return root


def _stars(cid: np.ndarray, items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> pa.RecordBatch:
    """Of buckets that begin at starts, a star (u, v) for each component within the radius."""
    two = starts[sizes == 2]
    two = two[_linked(items[two], items[two + 1], radius)]
    us, vs = [cid[two + 1]], [cid[two]]
    for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own, ids = items[s : s + size], cid[s : s + size]
        root = forest(own, np.zeros(size, int), radius) if size > 64 else star(size, lambda i, js, own=own: _linked(own[i], own[js], radius))
        linked = np.flatnonzero(root != np.arange(size))
        us.append(ids[linked])
        vs.append(ids[root[linked]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])


def _meet(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (key, cid, n, fp) sorted by key: the stars of each key's bucket, which may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars(key: np.ndarray, cid: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return _stars(cid, items, starts, np.diff(np.append(starts, len(key))), radius)

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), b.column(1).to_numpy(), _items(b.column(2), b.column(3))]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if cut := int(np.searchsorted(held[0], held[0][-1])):
                yield stars(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield stars(*held)

    return run


def link(classes: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of cids that join the same classes (cid, n, fp, samples) as all pairs would that share a sample's
    fingerprint and lie within the radius and a fifth of their sizes.

    Classes with an equal sample fingerprint are a bucket. Unrelated texts share none, so the rows that meet grow with the
    texts and their copies, not with the square of the texts. A task returns a star for each component that it finds, never its pairs.
    """
    spark = classes.sparkSession
    keys = classes.select(F.explode("samples").alias("key"), "cid").repartition(scratch.partitions(spark), "key")
    sizes = keys.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = keys.join(sizes, F.col("key") == F.col("k")).select("key", "m", F.col("cid").alias("c"))
    buckets = scratch.stage(shared.join(classes.select("cid", "n", "fp"), F.col("c") == F.col("cid")).select("key", "m", "cid", "n", "fp"), "copies-buckets")
    small = buckets.where(F.col("m") <= CELL).select("key", "cid", "n", "fp").repartition(scratch.partitions(spark), "key")
    met = small.sortWithinPartitions("key", "cid").mapInArrow(_meet(radius), "u long, v long")
    large = buckets.where(F.col("m") > CELL)
    return met.union(_link_large(large, radius)) if large.count() else met


def _link_large(buckets: DataFrame, radius: int) -> DataFrame:
    """The links of buckets (key, cid, n, fp) of any size.

    The tree comes from about SAMPLE classes and deals out every row of a bucket to leaves. In a leaf all rows are compared to
    its first one, and those that it does not link to all others, over blocks of CELL rows: a leaf of copies costs
    its rows, one of texts without links the square of its rows.
    """
    spark, items = buckets.sparkSession, buckets.select("cid", "n", "fp").dropDuplicates(["cid"])
    sample = items.where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(max(1, items.count() // SAMPLE))) == 0).orderBy("cid").toArrow()
    tree = CopyTree(_items(sample.column("n"), sample.column("fp")), radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, rows in tree.route(_items(b.column(2), b.column(3))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int64)), *[c.take(pa.array(rows)) for c in b.columns]], ["leaf", "key", "cid", "n", "fp"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            led = _linked(_items(b.column(3), b.column(4)), _items(b.column(6), b.column(7)), radius) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(led)], ["leaf", "key", "cid", "n", "fp", "first", "led"])

    routed = scratch.stage(buckets.select("key", "cid", "n", "fp").mapInArrow(route, "leaf long, key long, cid long, n long, fp binary"), "copies-leaves")
    firsts = routed.groupBy(F.col("key").alias("k"), F.col("leaf").alias("l")).agg(F.min(F.struct("cid", "n", "fp")).alias("f"))
    firsts = scratch.small(firsts.select("k", "l", F.col("f.cid").alias("first"), F.col("f.n").alias("first_n"), F.col("f.fp").alias("first_fp")), "copies-firsts")
    with_first = routed.join(firsts, (F.col("key") == F.col("k")) & (F.col("leaf") == F.col("l"))).select("leaf", "key", "cid", "n", "fp", "first", "first_n", "first_fp")
    followed = scratch.stage(with_first.mapInArrow(follow, "leaf long, key long, cid long, n long, fp binary, first long, led boolean"), "copies-followed")
    sizes = followed.groupBy(F.col("key").alias("k"), F.col("leaf").alias("l")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"), F.count(F.when(~F.col("led"), 1)).alias("left"))
    open_ = followed.join(scratch.small(sizes.where("left > 0"), "copies-sizes"), (F.col("key") == F.col("k")) & (F.col("leaf") == F.col("l")))
    open_ = open_.withColumn("x", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    own = open_.select("key", "leaf", F.col("x").alias("o"), F.lit(1).alias("side"), "cid", "n", "fp")
    left = open_.where("not led").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("o <> x")

    def compare(table: pa.Table) -> pa.Table:
        """A block's own rows (side 1) meet one another and those of other blocks (side 0)."""
        order = np.lexsort((table.column("cid").to_numpy(), table.column("side").to_numpy()))
        cid, side = table.column("cid").to_numpy()[order], table.column("side").to_numpy()[order]
        items, cut, u, v = _items(table.column("n"), table.column("fp"))[order], int(np.count_nonzero(side == 0)), [], []
        for start in {0, cut} if cut < len(cid) else ():
            root = forest(items[start:], side[start:] if start < cut else np.zeros(len(cid) - start, int), radius)
            linked = np.flatnonzero(root != np.arange(len(root)))
            u.append(cid[start:][linked])
            v.append(cid[start:][root[linked]])
        return pa.table({"u": np.concatenate([*u, np.zeros(0, np.int64)]), "v": np.concatenate([*v, np.zeros(0, np.int64)])})

    met = own.union(left.select("key", "leaf", "o", F.lit(0).alias("side"), "cid", "n", "fp")).groupBy("key", "leaf", "o").applyInArrow(compare, "u long, v long")
    return met.union(followed.where("led and cid <> first").select(F.col("cid").alias("u"), F.col("first").alias("v")))


def _verify(table: pa.Table) -> pa.Table:
    """Rows (cid, text) of candidates: a star for each component over similarities of 0.8 or more, computed on whole sets."""
    cid = table.column("cid").to_numpy()
    order = np.argsort(cid, kind="stable")
    texts, cid = table.column("t"), cid[order]
    sets = [shingles(texts[int(i)].as_py()) for i in order]
    n = np.array([len(s) for s in sets])
    starts = np.cumsum(n) - n
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(distinct), bool)

    def close(i: int, js: np.ndarray) -> np.ndarray:
        mine[flat[starts[i] : starts[i] + n[i]]] = True
        both = np.add.reduceat(mine[flat], starts, dtype=np.int64)[js]
        mine[flat[starts[i] : starts[i] + n[i]]] = False
        return 9 * both >= 4 * (n[i] + n[js])  # both / (n[i] + n[j] - both) >= 4/5

    root = star(len(n), close)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"u": cid[linked], "v": cid[root[linked]]})


def near_copies(marked: DataFrame) -> DataFrame:
    """(_id, _h, component) for each row of marked docs: texts with similarity of 0.8 or more, or a chain of such, share a component.

    Texts with equal sets are one class, named by the sets' hash. Classes meet by equal SimHash fingerprints of samples of their
    sets and link by the whole sets' SimHash fingerprints within a radius, which gives the candidates. Groups of candidates so
    joined are then compared on whole sets, large ones in blocks that meet pair by pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, n, fps, own = [], [], [], []
            for t in batch.column(2):
                hashes = shingles(t.as_py())
                cid.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - 2**63)
                n.append(len(hashes))
                fps.append(fingerprint(hashes))
                own.append(samples(hashes).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["_id", "_h", "cid", "n", "fp", "samples"])

    rows = scratch.stage(marked.select("_id", "_h", F.col("text").cast("binary")).mapInArrow(run, "_id long, _h long, cid long, n long, fp binary, samples array<long>"), "copies-rows")
    classes = rows.groupBy("cid").agg(F.min(F.struct("_id", "_h")).alias("of"), *[F.first(c).alias(c) for c in ("n", "fp", "samples")])
    classes = scratch.stage(classes.select("cid", F.col("of._id").alias("i"), F.col("of._h").alias("h"), "n", "fp", "samples"), "copies-classes")
    met = link(classes, RADIUS)
    joined = scratch.stage(components(met).select(F.col("id").alias("c"), F.col("component").alias("around")), "copies-candidates")
    members = joined.join(classes.select("cid", "i", "h", "n"), F.col("c") == F.col("cid"))
    sizes = members.groupBy(F.col("around").alias("g")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(sizes, F.col("around") == F.col("g")).select("cid", "around", "i", "h", "blocks")
    texts = marked.select("_id", "_h", F.col("text").cast("binary").alias("t")).join(members, (F.col("_id") == F.col("i")) & (F.col("_h") == F.col("h"))).dropDuplicates(["_id", "_h"])
    dealt = (
        texts.withColumn("x", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("y", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: y != F.col("x")))))
        .select("around", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "cid", "t")
    )
    found = components(dealt.groupBy("around", "x", "y").applyInArrow(_verify, "u long, v long"))
    return rows.join(found, F.col("cid") == F.col("id"), "left").select("_id", "_h", F.coalesce("component", "cid").alias("component"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays: the one with the smallest doc_id (null last), then the smallest row hash.

    Null, empty and blank texts are copies of one another; a text of five words or fewer is one shingle. Columns of docs may
    have any names; an empty table stays empty."""
    marked = mark(docs)
    return first_of_each(marked, near_copies(marked), docs.columns)


#: `deduplicate` over documents: equal sets are one class; classes that share shingles are compared on their whole sets
APPLY_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
sets as materialized (select doc_id, list_sort(list_distinct(case when len(ws) <= {SHINGLE} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) end)) as s from d),
classes as materialized (select min(doc_id) as c, s from sets group by s),
one as (select c, len(s) as n, unnest(s) as g from classes),
pairs as materialized (select a.c as a, b.c as b from one a join one b on a.g = b.g and a.c <> b.c group by a.c, b.c, a.n, b.n having 9 * count(*) >= 4 * (a.n + b.n)),
reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
gone as (select a from reach where b < a)
select doc_id, text, lang, source from documents where doc_id in (select c from classes) and doc_id not in (select a from gone)
"""
