"""Tables, figures, references and regions inside texts, and the passages that a statement rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
TABLE = r"(?im)^\s*table\s+\d+"
FIGURE = r"(?im)^\s*(?:figure|fig\.?)\s+\d+"
REFERENCES = r"(?im)^\s*references\s*$"
REFERENCE = r"^\[?\d+\]?[.\)]?\s+\w"
WORD = "[А-Яа-яЁёA-Za-z0-9]{4,}"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start,end>> of all matches of a pattern that never matches the empty string.

    Starts come from the lengths of the parts between the matches: no shuffle and no Python.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("h")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(steps, empty, lambda a, x: F.struct((a["at"] + x["g"] + x["h"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["h"]).alias("end")))).alias("out")), lambda a: a["out"])


def captions(docs: DataFrame, pattern: str, tag: str) -> DataFrame:
    """(doc_id, ref, start, end, caption): the first line of the 140 characters from each match on."""
    at = docs.select("doc_id", "text", F.posexplode(found(F.col("text"), pattern)).alias("n", "m"))
    line = F.substring_index(F.substring(F.col("text"), F.col("m.start") + 1, F.lit(140)), "\n", 1)
    return at.select("doc_id", F.concat(F.lit(f"{tag}-"), F.col("n")).alias("ref"), "m.start", "m.end", F.trim(line).alias("caption"))


def reference_lines(text: Column) -> Column:
    """array<struct<ref,raw>>: numbered lines after the first line that says 'references', 300 characters of each at most."""
    tail = F.get(F.split(text, REFERENCES, 2), F.lit(1))
    lines = F.filter(F.transform(F.split(tail, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(REFERENCE))
    refs = F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("ref-"), i).alias("ref"), F.substring(x, 1, 300).alias("raw")))
    return F.coalesce(refs, F.array().cast("array<struct<ref:string,raw:string>>"))


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, raw) of documents (doc_id, text)."""
    return docs.select("doc_id", F.explode(reference_lines(F.col("text"))).alias("r")).select("doc_id", "r.ref", "r.raw")


def regions(lo: Column, hi: Column, atoms: Column) -> Column:
    """array<struct<start,end,ref>> that covers [lo, hi): atoms (array<struct<start,end,ref>>) and, with null ref, the text between.

    Atoms are clipped to the section; of overlapping ones the later keeps what the earlier leaves.
    """
    inside = F.filter(F.transform(atoms, lambda a: F.struct(F.greatest(a["start"], lo).alias("start"), F.least(a["end"], hi).alias("end"), a["ref"].alias("ref"))), lambda a: a["start"] < a["end"])
    kind = "array<struct<start:int,end:int,ref:string>>"
    piece = lambda s, e, ref: F.when(s < e, F.array(F.struct(s.alias("start"), e.alias("end"), ref.alias("ref")))).otherwise(F.array().cast(kind)).cast(kind)
    none = F.lit(None).cast("string")
    start = F.struct(lo.cast("int").alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = F.greatest(x["start"], a["at"])
        return F.struct(F.greatest(a["at"], x["end"]).cast("int").alias("at"), F.concat(a["out"], piece(a["at"], s, none), piece(s, x["end"], x["ref"])).alias("out"))

    return F.aggregate(F.array_sort(inside), start, step, lambda a: F.concat(a["out"], piece(a["at"], hi, none)))


def source_passages(units: DataFrame, statements: DataFrame, k: int = 2, cap: int = 1400) -> DataFrame:
    """(uuid, source): the k units of a statement's paper that share the most of its words, joined.

    units: paper_ref, unit, text; statements: uuid, paper_ref, statement. Words are distinct, lower-cased, of four letters at
    least. Statements without a match are left out. Joined by (paper, word), counted before the texts are fetched.
    """
    words = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))
    u = units.select("paper_ref", "unit", F.explode(words(F.col("text"))).alias("word"))
    s = statements.select("uuid", "paper_ref", F.explode(words(F.col("statement"))).alias("word"))
    n = s.join(u, ["paper_ref", "word"]).groupBy("uuid", "paper_ref", "unit").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("uuid").orderBy(F.desc("n"), "unit"))
    best = n.withColumn("rank", rank).where(F.col("rank") <= k).join(units, ["paper_ref", "unit"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return best.groupBy("uuid").agg(F.substring(F.array_join(parts, "\n---\n"), 1, cap).alias("source"))
