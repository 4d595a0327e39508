"""SimHash near-duplicates: 64-bit fingerprints, matched exactly within a Hamming radius over a vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm.components import components
from factloom.llm.rows import first_of_each, mark

SHINGLE, SEED, RADIUS = 3, 42, 3
LEAF, BLOCK, SAMPLE, LEAST_LEAVES, MOST_LEAVES = 2048, 8192, 524_288, 4, 65_536


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 (seed 42) of all k-word shingles, repeats included."""
    words = (text or b"").lower().split()  # on bytes both know ASCII only: A-Z, and \\x20 \\x09-\\x0D
    if not words:
        return 0
    one, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = [h(one, SEED)]
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        hashes = [h(one[i:j], SEED) for i, j in zip((ends - lens)[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer; a null or empty text gives 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, fp long")


class VantageTree:
    """Inner nodes hold a vantage point and the median distance to it; leaves are numbered by their place in the tree.

    ``route`` sends a fingerprint x inwards if d(x, point) <= median and outwards if d(x, point) > median - radius. Of two
    fingerprints within the radius, either both are inside, or one is outside and by the triangle inequality the other lies
    within the radius of the boundary, so both go outwards: every pair meets in a leaf.
    """

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius, self.nodes = radius, {}
        self._build(np.unique(sample), 1, max(0, int(np.ceil(np.log2(max(1, leaves))))))

    def _build(self, fps: np.ndarray, at: int, depth: int) -> None:
        if not depth or len(fps) < 16:
            return
        tries = fps[:: max(1, len(fps) // 8)][:8]
        far = np.bitwise_count(tries[:, None] ^ fps[None, : 4096])
        point = tries[int(np.argmax(far.std(axis=1)))]  # the point that tells most fingerprints apart
        d = np.bitwise_count(fps ^ point).astype(np.int64)
        median = int(np.median(d))
        inside = d <= median
        if inside.all() or d.max() <= median + 1:
            median = int(d.max()) // 2
            inside = d <= median
        if inside.all() or not inside.any():
            return
        self.nodes[at] = (point, median)
        self._build(fps[inside], 2 * at, depth - 1)
        self._build(fps[~inside], 2 * at + 1, depth - 1)

    def sides(self, fps: np.ndarray, point: np.uint64, median: int) -> tuple[np.ndarray, np.ndarray]:
        d = np.bitwise_count(fps ^ point).astype(np.int64)
        return d <= median, d > median - self.radius

    def route(self, fps: np.ndarray, at: int = 1, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        rows = np.arange(len(fps)) if rows is None else rows
        if not len(rows):
            return
        if at not in self.nodes:
            yield at, rows
            return
        inside, outside = self.sides(fps[rows], *self.nodes[at])
        yield from self.route(fps, 2 * at, rows[inside])
        yield from self.route(fps, 2 * at + 1, rows[outside])


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of few thousand fingerprints, the index of the first that its component within the radius reaches."""
    n, root = len(fps), np.arange(len(fps))
    near = np.zeros(n, bool)
    for i in range(0, n, 256):
        hit = np.bitwise_count(fps[i : i + 256, None] ^ fps[None, i:]) <= radius
        hit[np.arange(len(hit)), np.arange(len(hit))] = False
        near[i : i + len(hit)] |= hit.any(axis=1)
        near[i:] |= hit.any(axis=0)
    left = np.flatnonzero(near)
    while len(left):
        first, queue = left[0], [left[0]]
        left = left[1:]
        while queue:
            close = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= radius
            found, left = left[close], left[~close]
            root[found] = first
            queue.extend(found.tolist())
    return root


def link(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join the same fingerprints as all pairs of `classes` (fp, distinct) within the radius would.

    The tree comes from a sample of at most SAMPLE distinct fingerprints; it deals out every fingerprint, and its shape
    sets the cost, not the result. Leaves larger than BLOCK are cut into blocks by hash that meet pair by pair. A task
    returns a star for each component that it finds, never its pairs.
    """
    spark = classes.sparkSession
    n = classes.count()
    leaves = max(LEAST_LEAVES, min(MOST_LEAVES, -(-n // LEAF)))
    order = F.xxhash64("fp", F.lit(7))
    top = min(n, SAMPLE, 64 * leaves)
    sample = classes.where(order.bitwiseAND(F.lit(2**30 - 1)) < F.lit(min(2**30, int(2**30 * 1.2 * top / max(1, n)) + 2**14))).select("fp").orderBy(order).limit(top)
    tree = VantageTree(np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64), leaves, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for leaf, rows in tree.route(fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf, np.int64)), b.column(0).take(pa.array(rows))], ["leaf", "fp"])

    # leaf numbers may collide for other depths only if one is an ancestor of the other, which then is no leaf
    routed = scratch.stage(classes.repartition(scratch.partitions(spark), "fp").select("fp").mapInArrow(route, "leaf long, fp long"), "simhash-leaves")
    sizes = routed.groupBy(F.col("leaf").alias("l")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (
        routed.join(scratch.small(sizes, "simhash-sizes", 2 * MOST_LEAVES), F.col("leaf") == F.col("l"))
        .withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("b")))))
        .select("leaf", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "fp")
    )

    def compare(table: pa.Table) -> pa.Table:
        fps = np.sort(table.column("fp").to_numpy())
        root = forest(fps.view(np.uint64), radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": fps[linked], "v": fps[root[linked]]})

    return dealt.groupBy("leaf", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over fingerprints that differ in at most `radius` bits.

    Null, empty and blank texts have fingerprint 0 and link like any other. Rows of one id that repeat are returned as often.
    A null id links and leads on like any other and has no say in its component's name (null if the component has no
    other). Texts of any length are read whole, one at a time. Equal fingerprints become one class first, so a group of copies
    of any size is one row in the search; the classes are linked by fingerprint, and a component's name is the least id over
    its classes. Extra columns are ignored; an empty table gives no row.
    """
    fps = scratch.stage(fingerprints(docs, id_col, text_col), "simhash-fps")
    classes = scratch.stage(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    found = components(link(classes, radius)).select(F.col("id").alias("k"), F.col("component").alias("c"))
    joined = classes.join(found, F.col("fp") == F.col("k"), "left").select(F.col("fp").alias("f"), "rep", "c")
    names = joined.where("c is not null").groupBy(F.col("c").alias("n")).agg(F.min("rep").alias("name"))
    named = joined.join(names, F.col("c") == F.col("n"), "left").select("f", F.when(F.col("c").isNull(), F.col("rep")).otherwise(F.col("name")).alias("component"))
    return fps.join(named, F.col("fp") == F.col("f"), "left").select("id", "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: the one with the smallest doc_id (null last), then the smallest row hash."""
    marked = mark(docs)
    named = near_duplicates(marked, "_h").select("id", "component").distinct()  # row hashes tell rows of one id apart
    rows = named.join(marked.select("_id", "_h").distinct(), F.col("id") == F.col("_h"))
    return first_of_each(marked, rows, docs.columns)


def _sql() -> str:
    """XXH64 in 128-bit arithmetic over each distinct shingle's bytes, the bits' majorities, and all pairs of fingerprints."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))  # fixed values
    m, seed = f"{2**64}::uhugeint", f"{SEED}::uhugeint"
    turn = lambda x, r: f"list_transform([({x})::uhugeint * {2**r}], lambda y: y % {m} + y // {m})[1]"
    xor = lambda a, b: f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"
    step = lambda a, lane: f"({turn(f'({a} + {lane} * {p2} % {m}) % {m}', 31)} * {p1} % {m})"
    lane = lambda at, size: "(" + " + ".join(f"bytes[{at} + {k + 1}]::uhugeint * {256**k}::uhugeint" for k in range(size)) + ")"
    starts = [f"({seed} + {p1} + {p2}) % {m}", f"({seed} + {p2}) % {m}", seed, f"({m} + {seed} - {p1}) % {m}"]
    own = [f"list_reduce(list_concat([{s}], list_transform(range(n // 32), lambda i: lanes[4 * i + {k + 1}])), lambda a, x: {step('a', 'x')}) as v{k}" for k, s in enumerate(starts)]
    mixed = f"({' + '.join(turn(f'v{k}', r) for k, r in enumerate((1, 7, 12, 18)))}) % {m}"
    merged = f"list_reduce([{mixed}, v0, v1, v2, v3], lambda a, v: ({xor('a', step('0::uhugeint', 'v'))} * {p1} + {p4}) % {m})"
    eights = f"list_reduce(list_concat([a0], lanes[n // 32 * 4 + 1 :]), lambda a, x: ({turn(xor('a', step('0::uhugeint', 'x')), 27)} * {p1} + {p4}) % {m})"
    four = f"case when n % 8 >= 4 then ({turn(xor('a1', f'{lane("n // 8 * 8", 4)} * {p1} % {m}'), 23)} * {p2} + {p3}) % {m} else a1 end"
    ones = f"list_reduce(list_concat([a2], list_transform(bytes[n // 4 * 4 + 1 :], lambda b: b::uhugeint)), lambda a, b: {turn(xor('a', f'b * {p5} % {m}'), 11)} * {p1} % {m})"
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
o as (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {SHINGLE} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) end) as s from d),
b as (select s, octet_length(encode(s)) as n, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::bigint) as bytes from (select distinct s from o)),
l as (select *, list_transform(range(n // 8), lambda i: {lane("8 * i", 8)}) as lanes from b),
v as (select *, {", ".join(own)} from l),
a as (select s, n, bytes, lanes, (case when n < 32 then {seed} + {p5} else {merged} end + n::uhugeint) % {m} as a0 from v),
a1 as (select s, n, bytes, {eights} as a1 from a), a2 as (select s, n, bytes, {four} as a2 from a1), a3 as (select s, {ones} as a3 from a2),
z1 as (select s, {xor('a3', 'a3 // 8589934592::uhugeint')} * {p2} % {m} as z from a3), z2 as (select s, {xor('z', 'z // 536870912::uhugeint')} * {p3} % {m} as z from z1),
h as materialized (select s, {xor('z', 'z // 4294967296::uhugeint')}::ubigint as h from z2),
f as materialized (select doc_id, count(*) as n, {", ".join(f"sum((h >> {k}) & 1) as b{k}" for k in range(64))} from o join h using (s) group by doc_id),
p as materialized (select doc_id, coalesce({" + ".join(f"case when 2 * b{k} > n then {2**k}::uhugeint else 0 end" for k in range(64))}, 0)::ubigint as fp from documents left join f using (doc_id)),
c as materialized (select fp, min(doc_id) as rep from p group by fp),
e as materialized (select x.rep as a, y.rep as b from c x join c y on x.fp <> y.fp and bit_count(xor(x.fp, y.fp)::bit) <= {RADIUS}),
reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a),
low as (select a, min(b) as low from reach group by a)
select doc_id, lpad(lower(hex(fp)), 16, '0') as fingerprint, least(rep, coalesce(low, rep)) as component_id from p join c using (fp) left join low on a = rep
"""


ORACLE = _sql()
