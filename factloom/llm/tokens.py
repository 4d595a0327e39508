"""Token ids in files of bit or byte planes.

A table of token files is a Parquet table (Spark commits it whole, in any store it knows) with a row for each chunk:

    file, chunk     the file's number, ascending with the document id, and the chunk's number in it
    first, n_ids    the chunk's first id, counted over the file, and its ids
    doc_ids, lens   its whole documents in order, and the ids of each
    width, block    bytes of an id (2 or 4) and ids of a block
    bits            1 for bit planes, 8 for byte planes
    planes          compressed bytes of each plane, block by block: the chunk's index
    payload         the planes, one after the other

A block's ids, padded with zeros to a multiple of 8, are transposed into 8 * width bit planes or width byte planes, from the
least on; each plane is compressed with zstandard. All columns but payload are the chunk index, read without it.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import scratch

END, BLOCK, CHUNK, MEMO, LONG = 2, 65_536, 1 << 20, 900_000, 64
SCHEMA = "file int, chunk int, first long, n_ids long, doc_ids array<long>, lens array<long>, width int, block int, bits int, planes array<int>, payload binary"
#: A byte-level BPE with the usual split pattern never joins a token over the edge of these pieces: a run of other
#: characters with the one space before it, white space up to the last before such a run, or that last one.
#: White space is Unicode's, without the separators \x1c-\x1f that Python adds to it.
PIECE = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]")
#: Pieces that the split pattern leaves whole (letters alone) or cuts once (letters, then marks that it takes together).
WORD = re.compile(r"( ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
_encoders: dict[str, Encoder] = {}


def _letters() -> dict[int, str]:
    """The characters that a byte-level model has for bytes: printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(others)}


class Encoder:
    """Encodes with the tokenizers library; ids of pieces that occur again are remembered by each worker: MEMO pieces of LONG
    characters at most, and as many of an older generation, from which those still in use move on.

    Texts are cut into pieces only for a byte-level BPE with the usual split pattern, no normaliser and no prefix; any other
    tokenizer encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: list[dict[str, bytes]] = [{}, {}]
        self.packs: dict[int, struct.Struct] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        parts = json.loads(self.tokenizer.to_str())
        model, split = parts["model"], parts["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.cuts = bool(level and plain and model["type"] == "BPE" and parts["normalizer"] is None and not any(t["lstrip"] or t["single_word"] for t in parts["added_tokens"]))
        self.letters, self.model = str.maketrans(_letters()), self.tokenizer.model
        self.within = [x for x in self.special if WORD.fullmatch("a" + x)]  # special tokens that a piece of letters and marks can hold

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own, with what it remembers."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def pack(self, n: int) -> struct.Struct:
        if n not in self.packs:
            self.packs[n] = struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}")
        return self.packs[n]

    @property
    def known(self) -> dict[str, bytes]:
        return self.memo[0]

    def _one(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, piece: str) -> bytes:
        """Ids of one part of the split pattern, by the library's model alone."""
        got = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return self.pack(len(got)).pack(*[t.id for t in got])

    def _learn(self, new: set[str]) -> None:
        """Letters, and marks behind them, are encoded apart from each other, as the split pattern does; other pieces as they are."""
        known, rest = self.known, []
        for p in new:
            m = WORD.fullmatch(p)
            if m is None or (self.within and any(x in p for x in self.within)):
                rest.append(p)
                continue
            word, marks = m.groups()
            got = known.get(word)
            if got is None:
                got = known[word] = self._word(word)
            if marks:
                tail = known.get(marks)
                if tail is None:
                    tail = known[marks] = self._word(marks)
                known[p] = got + tail
        known.update(zip(rest, self._one(rest), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return self._one([t or "" for t in texts])
        # a special token ends the text before it, and with it a run of white space: such a text is one piece
        pieces = [([t] if any(x in t for x in self.special) else PIECE.findall(t)) if t else [] for t in texts]
        if len(self.known) > MEMO:
            self.memo[:] = [{}, self.known]
        known, older = self.memo
        flat = list(chain.from_iterable(pieces))
        got = list(map(known.get, flat))
        if missing := [i for i, x in enumerate(got) if x is None]:
            new = {flat[i] for i in missing}
            long = [p for p in new if len(p) > LONG]
            once = dict(zip(long, self._one(long), strict=True))
            new.difference_update(long)
            back = {p: older[p] for p in new if p in older}
            known.update(back)
            new.difference_update(back)
            self._learn(new)
            for i in missing:
                got[i] = once.get(flat[i]) or known[flat[i]]
        out, at = [], 0
        for ps in pieces:
            out.append(b"".join(got[at : at + len(ps)]))
            at += len(ps)
        return out


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """A block's bit planes (bits 1) or byte planes (bits 8), from the least on, each compressed."""
    width = ids.dtype.itemsize
    raw = np.zeros(-(-len(ids) // 8) * 8, ids.dtype)
    raw[: len(ids)] = ids
    table = raw.view(np.uint8).reshape(-1, width)
    planes = np.packbits(np.unpackbits(table, axis=1, bitorder="little").T, axis=1, bitorder="little") if bits == 1 else np.ascontiguousarray(table.T)
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    z = zstandard.ZstdDecompressor()
    table = np.stack([np.frombuffer(z.decompress(p, max_output_size=n + 8), np.uint8) for p in planes])
    if bits == 1:
        table = np.packbits(np.unpackbits(table, axis=1, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(table.T).reshape(-1).view(f"<u{len(planes) * bits // 8}")[:n]


def encode_chunk(ids: np.ndarray, block: int, bits: int) -> tuple[list[int], bytes]:
    planes = [p for i in range(0, len(ids), block) for p in to_planes(ids[i : i + block], bits)]
    return [len(p) for p in planes], b"".join(planes)


def decode_chunk(sizes: list[int], payload: bytes, n: int, width: int, block: int, bits: int) -> np.ndarray:
    cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).tolist()
    planes = [payload[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    step = 8 * width // bits
    parts = [from_planes(planes[k * step : (k + 1) * step], min(block, n - k * block), bits) for k in range(len(planes) // step)]
    return np.concatenate(parts) if parts else np.zeros(0, f"<u{width}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, block: int = BLOCK, chunk: int = CHUNK, bits: int = 8) -> None:
    """Encodes every whole text (null: empty), adds `end`, and writes the ids in ascending order of doc_id.

    Null ids come first; rows of one id follow by text, each a document of its own, and equal rows are interchangeable. Texts of
    any length are encoded whole. Extra columns are ignored; an empty table gives a table of files without a row. Documents are dealt by ranges of the id before they are encoded, so they are encoded once; a range is a file. A chunk
    holds whole documents of `chunk` ids or a little more, a longer document a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, number, first = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0, 0
        tail = b"" if end is None else np.array([end], f"<u{encode.width}").tobytes()
        ids, lens, parts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(parts), f"<u{encode.width}")
            planes, payload = encode_chunk(values, block, bits)
            row = [file, number, first, len(values), ids, lens, encode.width, block, bits, planes, payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                own = b.slice(at, 64)
                for doc, got in zip(own.column(0).to_pylist(), encode(own.column(1).to_pylist()), strict=True):
                    got += tail
                    ids.append(doc)
                    lens.append(len(got) // encode.width)
                    parts.append(got)
                    size += lens[-1]
                    if size >= chunk:
                        yield out()
                        number, first = number + 1, first + size
                        ids, lens, parts, size = [], [], [], 0
        if ids:
            yield out()

    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    dealt = own.repartitionByRange(scratch.partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, in any order, and width and, if wanted, ids (little-endian bytes).

    start counts the ids of all documents before: files' totals (a row a file) are summed up in front of the place in the file.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy(F.col("file").alias("f")).agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.small(totals.select("f", before.alias("offset")), "tokens-offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = decode_chunk(row["planes"], row["payload"], row["n_ids"], row["width"], row["block"], row["bits"])
                ends = np.cumsum(row["lens"], dtype=np.int64)
                starts = ends - row["lens"]
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                raw = [ids[i:j].tobytes() if with_ids else None for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["offset"] + row["first"]), pa.array(row["lens"], pa.int64()), pa.array(crc, pa.int64()), pa.array([row["width"]] * len(raw), pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "width", "ids"])

    chunks = files.join(offsets, F.col("file") == F.col("f")).select("offset", "first", "n_ids", "doc_ids", "lens", "width", "block", "bits", "planes", "payload")
    return chunks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, width int, ids binary")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents by byte_bpe_50k.json with id 2 at each end, written and read back."""
    import public_tokenizers

    path = scratch.new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, False).select("doc_id", "start", "n_tokens", "ids_crc32")
