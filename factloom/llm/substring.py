"""Substring deduplication: word windows seen in an earlier document, counted over super-k-mers.

Documents are dealt into batches by a hash of their id and text. A batch cuts its texts into super-k-mers: runs of consecutive
windows with the same minimiser (the least hash of three consecutive words in the window). Each distinct super-k-mer of a
batch travels once, as one packed string with the smallest id that has it there, to the bucket of its minimiser. All equal
windows have equal minimisers, so a bucket sees all occurrences of its windows; it sorts them by a 64-bit hash, compares
the words of equal hashes, and returns to each batch the smallest id of every window.

Inside a passage that a third of the documents share, a bucket gets one string for each batch, not for each document. At its
edges every document's own words follow, in windows that hold words of the passage too: would these share the passage's
minimiser, one bucket had them all. So words in a row that many of a sample of documents hold count as larger than all
others: such a window takes its minimiser from the document's own words, and the edges spread over the buckets. The sample
sets the order of minimisers, so cost, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm import scratch

WINDOW, MINIMISER, NONE = 13, 3, 2**63 - 1
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: Documents that tell which words in a row are common, in how many of them they must lie for that, and how many count as common.
SAMPLE, COMMON, MOST_COMMON = 2048, 32, 65_536
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


#: White space by byte, a number for each byte, and one for each place in a word: a word's hash is the sum of their products.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * _M[0]) * _M[1])
_PLACE = np.cumprod(np.full(64, _M[2] | np.uint64(1)))


class Words:
    """The words of texts, each followed by one space in `packed`; starts and ends of each there, and each text's words: first[k] to first[k + 1]."""

    def __init__(self, texts: list[bytes | None]):
        raw = np.frombuffer(b"".join(x for t in texts for x in (t or b"", b"\n")), np.uint8)
        space = _SPACE[raw]
        behind = np.concatenate([[True], space[:-1]])  # white space before each byte
        begin, last = np.flatnonzero(~space & behind), space & ~behind
        limits = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
        self.counts = np.bincount(np.searchsorted(limits, begin, side="right"), minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        sizes = np.flatnonzero(last) - begin
        del behind, begin
        packed = raw[~space | last]
        del raw, space, last
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        packed[self.ends] = 0x20
        self.bytes, self.packed = packed, packed.tobytes()

    def hashes(self, step: int = 1 << 17) -> np.ndarray:
        """A hash of each word, some words at a time. Words that share one only share a bucket."""
        out = np.zeros(len(self.ends), np.uint64)
        for i in range(0, len(out), step):
            starts, ends = self.starts[i : i + step], self.ends[i : i + step]
            own = self.bytes[starts[0] : ends[-1] + 1]
            place = np.arange(len(own)) - np.repeat(starts - starts[0], ends - starts + 1)
            out[i : i + step] = np.add.reduceat(_BYTE[own] * _PLACE[place & 63], starts - starts[0])
        return _mix(out)

    def text(self, k: int) -> bytes:
        """A text's words, joined by one space."""
        a, b = self.first[k], self.first[k + 1]
        return self.packed[self.starts[a] : self.ends[b - 1]] if b > a else b""

    def without(self, k: int, gone: np.ndarray) -> bytes:
        """A text's words but those of `gone` (a flag for each of its words), joined by one space."""
        a, b = self.first[k], self.first[k + 1]
        stay = np.repeat(~gone, self.ends[a:b] - self.starts[a:b] + 1)
        return self.bytes[self.starts[a] : self.ends[b - 1] + 1][stay].tobytes()[:-1]


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all MINIMISER words in a row."""
    n = max(0, len(hashes) - MINIMISER + 1)
    out = hashes[:n] * _M[0]
    for k in range(1, MINIMISER):
        out += hashes[k : n + k] * _M[k]
    return _mix(out) >> np.uint64(1)


def _common(rows: DataFrame) -> np.ndarray:
    """The sorted hashes of words in a row that many documents of a sample hold; rows: k, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_grams(Words([t.as_py()]).hashes())).view(np.int64))], ["h"])

    part = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("k", F.octet_length("t"), F.lit(7)), F.lit(part)) == 0).select("t")
    top = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON)
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


class Batch:
    """The words of a batch and its distinct super-k-mers, numbered in the order of their first occurrence.

    texts and ids are in a fixed order; for each super-k-mer occurrence k: doc[k], first window word at[k] (counted over
    the batch), windows[k], string[k] (number of its distinct string).
    """

    def __init__(self, texts: list[bytes | None], ids: np.ndarray, window: int, common: np.ndarray):
        self.ids, self.words = ids, Words(texts)
        n = len(self.words.ends)
        self.doc = self.at = self.windows = self.string = self.least = np.zeros(0, np.int64)
        self.minimiser, self.strings = np.zeros(0, np.uint64), []
        if n < window:
            return
        grams = _grams(self.words.hashes())
        if len(common):
            at = np.searchsorted(common, grams)
            np.minimum(at, len(common) - 1, out=at)
            grams[common[at] == grams] |= np.uint64(1 << 63)
            del at
        least = _least(grams, window - MINIMISER + 1)  # of the window at each word
        del grams
        doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), self.words.counts)
        where = np.flatnonzero(doc_of[: len(least)] == doc_of[window - 1 :][: len(least)])
        if not len(where):
            return
        start = np.ones(len(where), bool)
        start[1:] = (np.diff(where) != 1) | (least[where[1:]] != least[where[:-1]]) | (doc_of[where[1:]] != doc_of[where[:-1]])
        begin = np.flatnonzero(start)
        self.at, self.windows = where[begin], np.diff(np.concatenate([begin, [len(where)]]))
        self.doc, minimiser = doc_of[self.at].astype(np.int64), least[self.at]
        del where, start, begin, doc_of, least
        packed = self.words.packed
        lo, hi = self.words.starts[self.at].tolist(), self.words.ends[self.at + self.windows + window - 2].tolist()
        number: dict[bytes, int] = {}
        self.string = np.fromiter((number.setdefault(packed[i:j], len(number)) for i, j in zip(lo, hi, strict=True)), np.int64, len(lo))
        self.strings = list(number)
        self.least = np.full(len(number), NONE, np.int64)
        np.minimum.at(self.least, self.string, ids[self.doc])
        most = np.full(len(number), np.iinfo(np.int64).min, np.int64)
        np.maximum.at(most, self.string, ids[self.doc])
        self.many = most > self.least
        self.minimiser = np.zeros(len(number), np.uint64)
        self.minimiser[self.string] = minimiser


def _pack(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    cuts = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n, 8))])
    return [raw[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _send(b: Batch, batch: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """For each bucket, the batch's strings of it: numbers, smallest ids, whether several documents have them, and texts."""
    if not b.strings:
        return
    bucket = (b.minimiser % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = order[i:j]
        yield int(bucket[own[0]]), batch, _pack(own.astype(np.int32).tobytes(), b.least[own].tobytes(), b.many[own].tobytes(), b"\n".join(b.strings[k] for k in own.tolist()))


def _first_ids(texts: bytes, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For newline-separated strings with their ids: windows of each string, and of each window the smallest id that has it."""
    raw = np.frombuffer(texts, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    last = np.flatnonzero(np.concatenate([raw[gaps] == 10, [True]]))  # the last word of each string
    words = np.diff(np.concatenate([[-1], last]))
    windows = words - window + 1
    at = np.arange(windows.sum()) + np.repeat(np.concatenate([[0], np.cumsum(words)[:-1]]) - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    lo, hi = start[at].tolist(), end[at + window - 1].tolist()
    h = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((h(texts[i:j]) for i, j in zip(lo, hi, strict=True)), np.uint64, len(lo))
    own = np.repeat(ids, windows)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    apart = False
    for k in np.flatnonzero(same).tolist():  # equal hashes: compare the words
        p, q = order[k], order[k + 1]
        if texts[lo[p] : hi[p]] != texts[lo[q] : hi[q]]:
            apart = True
            break
    if apart:  # two windows share a hash: sort by the words themselves
        order = np.array(sorted(range(len(lo)), key=lambda k: texts[lo[k] : hi[k]]), np.int64)
        same = np.array([texts[lo[p] : hi[p]] == texts[lo[q] : hi[q]] for p, q in zip(order[:-1], order[1:], strict=True)], bool)
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.minimum.reduceat(own[order], heads)
    first = np.empty(len(own), np.int64)
    first[order] = np.repeat(low, np.diff(np.concatenate([heads, [len(own)]])))
    return windows, first


def _count(batches: list[int], blobs: list[bytes], window: int) -> Iterator[tuple[int, bytes]]:
    """For each batch, its strings that may hold a window of an earlier document: number, windows, first ids of the windows."""
    parts = [_unpack(x) for x in blobs]
    numbers, least, many = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) for k, t in enumerate((np.int32, np.int64, np.bool_)))
    each = [len(p[0]) // 4 for p in parts]
    texts = b"\n".join(p[3] for p in parts)
    del parts
    windows, first = _first_ids(texts, least, window)
    ends = np.cumsum(windows)
    tell = many | (np.minimum.reduceat(first, ends - windows) < least)
    row = 0
    for batch, n in zip(batches, each, strict=True):
        own = row + np.flatnonzero(tell[row : row + n])
        row += n
        if len(own):
            ids = np.concatenate([first[ends[k] - windows[k] : ends[k]] for k in own.tolist()])
            yield batch, _pack(numbers[own].tobytes(), windows[own].astype(np.int32).tobytes(), ids.tobytes())


def _covered(b: Batch, verdicts: list[bytes], window: int) -> np.ndarray:
    """For each word of the batch, whether a window of an earlier document covers it."""
    n = int(b.words.first[-1])
    first = [None] * len(b.strings)
    for x in verdicts:
        numbers, windows, ids = (np.frombuffer(p, t) for p, t in zip(_unpack(x), (np.int32, np.int32, np.int64), strict=True))
        ends = np.cumsum(windows)
        for k, lo, hi in zip(numbers.tolist(), (ends - windows).tolist(), ends.tolist(), strict=True):
            first[k] = ids[lo:hi]
    told = np.fromiter((x is not None for x in first), bool, len(first))
    step = np.zeros(n + 1, np.int64)
    for k in np.flatnonzero(told[b.string]).tolist() if len(first) else ():
        hit = b.at[k] + np.flatnonzero(first[b.string[k]] < b.ids[b.doc[k]])
        if len(hit):
            step[hit] += 1
            step[hit + window] -= 1
    return np.cumsum(step[:n]) > 0


def _texts(table: pa.Table) -> tuple[list[bytes | None], np.ndarray, pa.Table]:
    """The batch's rows in an order that does not depend on how they arrived."""
    texts, ids = table.column("t").to_pylist(), table.column("k").to_numpy()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i] or b""))
    return [texts[i] for i in order], ids[order], table.take(pa.array(order, pa.int64()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, text: every word goes that a window of `window` consecutive words covers whose word sequence
    also starts in a document with a smaller id; what is left is joined by one space. If asked for, also `carry` as struct row,
    and then a text that loses nothing stays as it was. Windows are judged on the input.

    Words are runs other than \\x20 \\x09-\\x0D, unchanged. Null and empty texts have no words and an empty result; texts
    of fewer words than a window keep them. A text of any length is cut whole, in the batch that it lies in. Rows of one id count as one document. A null id counts as larger than any
    other, and such rows as one document. An empty table gives no row. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("k"), F.col("text").cast("binary").alias("t"), *([F.struct(*carry).alias("row")] if carry else []))
    kind = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("text", "string")
    kind = kind.add("row", rows.schema["row"].dataType) if carry else kind  # with its fields' own nullability
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    batches = max(scratch.partitions(spark), -(-total // BATCH_BYTES))
    buckets = max(scratch.partitions(spark), -(-3 * total // BUCKET_BYTES))
    common = _common(rows)
    dealt = rows.select(F.pmod(F.xxhash64("k", "t"), F.lit(batches)).alias("batch"), *rows.columns).repartition(scratch.tasks(spark, total), "batch")

    def send(table: pa.Table) -> pa.Table:
        texts, ids, _ = _texts(table)
        out = list(_send(Batch(texts, ids, window, common), table.column("batch")[0].as_py(), buckets))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "batch": pa.array([x[1] for x in out], pa.int64()), "blob": pa.array([x[2] for x in out], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        out = list(_count(table.column("batch").to_pylist(), table.column("blob").to_pylist(), window))
        return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "verdict": pa.array([x[1] for x in out], pa.binary())})

    def apply(table: pa.Table, told: pa.Table) -> pa.Table:
        texts, ids, table = _texts(table)
        b = Batch(texts, ids, window, common)
        gone = _covered(b, told.column("verdict").to_pylist(), window)
        kept, removed = [], []
        for k, t in enumerate(texts):
            own = gone[b.words.first[k] : b.words.first[k + 1]]
            removed.append(int(own.sum()))
            kept.append(b.words.without(k, own) if removed[-1] else t if carry else b.words.text(k))
        return pa.table({"doc_id": pa.array([None if i == NONE else i for i in ids.tolist()], pa.int64()), "n_words": pa.array(b.words.counts), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string())} | ({"row": table.column("row")} if carry else {}))

    sent = dealt.groupBy("batch").applyInArrow(send, "bucket long, batch long, blob binary").repartition(scratch.tasks(spark, 3 * total), "bucket")
    verdicts = sent.groupBy("bucket").applyInArrow(count, "batch long, verdict binary")
    return dealt.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(apply, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def apply(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without their repeats, with docs' columns: a text that loses words becomes its other words joined by one space
    (empty if none is left), any other text stays as it was; n_chars follows the text. A text travels once."""
    out = remove_repeats(docs, window, carry=[c for c in docs.columns if c != "text"])
    n_chars = lambda: F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    own = lambda c: F.col("text") if c == "text" else n_chars() if c == "n_chars" else F.col("row")[c]
    return out.select(*[own(c).alias(c) for c in docs.columns])


_FOUND = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (select doc_id, p, array_to_string(ws[p + 1 : p + {WINDOW}], ' ') as win from (select doc_id, ws, unnest(range(len(ws) - {WINDOW - 1})) as p from d)),
f as (select win, min(doc_id) as first from w group by win),
hit as (select w.doc_id, p from w join f using (win) where f.first < w.doc_id),
gone as (select distinct doc_id, p + k as p from hit, range({WINDOW}) r(k)),
g as (select doc_id, list(p) as ps from gone group by doc_id),
k as (select d.doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed, array_to_string(case when ps is null then ws else list_filter(ws, lambda x, i: not list_contains(ps, i - 1)) end, ' ') as kept from d left join g using (doc_id))
"""
ORACLE = f"{_FOUND} select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from k"
#: `apply` over documents
APPLY_SQL = f"{_FOUND} select doc_id, case when n_removed > 0 then kept else text end as text, lang, source from k join documents using (doc_id)"
