"""Language identification: the nearest of several TF-IDF centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import scratch
from factloom.llm.embedding import spherical_kmeans

#: n-gram slots, centroids for each language, documents to learn from in all, and characters taken at a time.
SLOTS, CENTROIDS, SAMPLE, STEP = 8192, 4, 4000, 1 << 20
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point, itself in lower case if it is a letter, else 0."""
    global _letter
    if _letter is None:
        _letter = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
                _letter[c] = ord(x.lower()[0])
    return _letter


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed runs of 1 to 3 characters, letters in lower case and all else one blank; null if no letter is there."""
    if not text:
        return None
    out, table, any_letter = np.zeros(SLOTS, np.int64), _letters(), False
    last = np.zeros(1, np.uint32)  # up to two codes from the step before; a text starts and ends with a blank
    out[0] += 1
    for at in range(0, len(text), STEP):
        raw = np.frombuffer((text[at : at + STEP] + " " * (at + STEP >= len(text))).encode("utf-32-le", "surrogatepass"), np.uint32)
        new = table[raw]
        any_letter |= bool(new.any())
        new = new[(new != 0) | (np.concatenate([last[-1:], new[:-1]]) != 0)]  # one blank for a run of them
        c = np.concatenate([last, new])
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ np.uint32(0x9E3779B9)) * np.uint32(668265263) + one[1:]
        three = (two[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(374761393) + one[2:]
        for h in (one[len(last) :], two[len(last) - 1 :], three):
            out += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(SLOTS), minlength=SLOTS)
        last = c[-2:]
    return out if any_letter else None


def _weigh(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(n) * idf).astype(np.float64)
    return x / max(1e-300, float(np.sqrt(x @ x)))


class Centroids:
    """A fitted model: idf of each slot, unit centroids with their languages, and the distance beyond which each rejects."""

    def __init__(self, langs: list[str], vectors: list[tuple[np.ndarray, np.ndarray]], per_lang: int = CENTROIDS):
        """vectors: the slots that a document has and their counts; one language's documents at a time are laid out in full."""
        seen = np.zeros(SLOTS, np.int64)
        for slots, _ in vectors:
            seen[slots] += 1
        self.idf = np.log((1 + len(vectors)) / (1 + seen)) + 0.1
        self.langs, cents, reject = [], [], []
        for lang in sorted(set(langs)):
            own = [v for v, x in zip(vectors, langs, strict=True) if x == lang]
            y = np.zeros((len(own), SLOTS), np.float32)
            for row, (slots, n) in zip(y, own, strict=True):
                w = np.log1p(n) * self.idf[slots]
                row[slots] = w / np.sqrt(w @ w)
            c = spherical_kmeans(y, min(per_lang, len(y)))
            self.langs += [lang] * len(c)
            cents.append(c)
            best = (y @ c.T).max(axis=1)
            reject += [float(best.mean() - 6 * best.std())] * len(c)
        self.centroids, self.reject = np.concatenate(cents).astype(np.float32), np.array(reject)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected): und, 0 and true without a letter; rejected if farther off than six deviations
        of the language's own documents."""
        n = counts(text)
        if n is None:
            return "und", 0.0, True
        cos = self.centroids @ _weigh(n, self.idf).astype(np.float32)
        k = int(cos.argmax())
        return self.langs[k], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] < self.reject[k])


def fit(rows: DataFrame, sample: int = SAMPLE) -> Centroids | None:
    """Learns from rows (doc_id, text, lang): at most `sample` labelled documents with a letter, an equal bound for each
    language, taken by a hash of doc_id and text, so null and repeated ids are rows like any other. Whole texts are counted where
    they lie; only their n-gram counts are gathered. Texts without a letter teach nothing; without any other there is no model."""
    rows = rows.where("lang is not null and text is not null")
    per = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not per:
        return None
    bound = max(1, sample // len(per))
    cut = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, bound / n))])
    h = F.xxhash64("doc_id", "text", F.lit(29))
    picked = rows.where(F.pmod(h, F.lit(1 << 30)) < F.element_at(cut, F.col("lang")) * (1 << 30)).select("lang", "text", h.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text, key in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (n := counts(text)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([key], pa.int64()), pa.array([np.flatnonzero(n).astype("<u2").tobytes()], pa.binary()), pa.array([n[n > 0].astype("<u4").tobytes()], pa.binary())], ["lang", "h", "slots", "n"])

    got = sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in picked.mapInArrow(run, "lang string, h long, slots binary, n binary").limit(2 * sample).collect()), key=lambda r: (r[1], *r))
    taken: dict[str, int] = {}
    langs, vectors = [], []
    for lang, _, slots, n in got:
        if (seen := taken.get(lang, 0)) < bound:
            taken[lang] = seen + 1
            langs.append(lang)
            vectors.append((np.frombuffer(slots, "<u2"), np.frombuffer(n, "<u4")))
    return Centroids(langs, vectors) if langs else None


def identify(docs: DataFrame, model: Centroids | None, keep: list[str]) -> DataFrame:
    """`keep` and lang_pred, score, rejected for every row of docs, from its whole text alone.

    lang_pred is `und` (score 0) if the text is null or has no letter, or if nothing could be learned; else the language of
    the nearest centroid, of equally near ones the first language's. rejected tells that even this one is too far. A text of
    any length is counted in steps. Rows that repeat get equal answers; columns beside `keep` are ignored; an empty table
    gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [model.predict(t) if model else ("und", 0.0, True) for t in b.column(len(keep)).to_pylist()]
            lang, score, rejected = zip(*told, strict=True) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose crc32(doc_id as text) mod 3 is 1 are held out of what is learned from. A null doc_id is not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    model = fit(docs.where("not held_out"))
    return identify(docs, model, ["doc_id", "held_out"])
