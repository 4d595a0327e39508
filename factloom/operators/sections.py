"""Sections, pages, anchors and chunks of whole texts. Offsets count code points; ends are exclusive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators import structure

SECTION = "array<struct<start:int,end:int,name:string,role_hint:string>>"


def sections(text: Column) -> Column:
    """array<struct<start,end,name,role_hint>> of a text by its heading lines; adjoining, covering the text.

    Text before the first heading is 'frontmatter', a text without headings one 'body'; an empty text has none. The structure
    is reliable with three headings or more. All in one row: no shuffle.
    """
    n = F.char_length(text)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,name:string>>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        head = F.when(fn.is_heading(line), F.array(F.struct(a["at"].alias("start"), line.alias("name")))).otherwise(F.array().cast("array<struct<start:int,name:string>>"))
        return F.struct((a["at"] + F.char_length(line) + 1).alias("at"), F.concat(a["out"], head).alias("out"))

    heads = F.aggregate(F.split(text, "\n"), begin, step, lambda a: a["out"])
    end = lambda i: F.coalesce(F.get(heads, i + 1)["start"], n)
    named = F.transform(heads, lambda h, i: F.struct(h["start"].alias("start"), end(i).alias("end"), F.regexp_replace(h["name"], r"(?U)^\s+|\s+$", "").alias("name"), fn.role_hint(h["name"]).alias("role_hint"))).cast(SECTION)
    part = lambda e, name: F.array(F.struct(F.lit(0).alias("start"), e.alias("end"), F.lit(name).alias("name"), F.lit(None).cast("string").alias("role_hint"))).cast(SECTION)
    front = F.get(heads, F.lit(0))["start"]
    whole = F.when(F.size(heads) == 0, part(n, "body")).when(front > 0, F.concat(part(front, "frontmatter"), named)).otherwise(named)
    return F.when(n > 0, whole).otherwise(F.array().cast(SECTION))


def page_map(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, end) of pages (doc_id, page, text) whose texts follow one another without a separator."""
    total = F.sum(F.char_length("text")).over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.select("doc_id", "page", (total - F.char_length("text")).alias("start"), total.alias("end"))


def page_of(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """offsets (doc_id, off) with the page that holds each, null where none does."""
    o, p = offsets.alias("o"), pages.alias("p")
    return o.join(p, (F.col("o.doc_id") == F.col("p.doc_id")) & (F.col("o.off") >= F.col("p.start")) & (F.col("o.off") < F.col("p.end")), "left").select("o.doc_id", "o.off", "p.page")


def pieces(text: str, budget: int, overlap: int, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Parts of at most `budget` tokens, cut at the coarsest mark that is there, and finer where a part is still too long; each
    starts with as many of the last parts before it as `overlap` tokens hold. Tokens are counted for each part between marks
    (four characters one, rounded down, and one at least) and summed, so a text of short words holds more characters."""
    tokens = lambda s: max(1, len(s) // 4)
    depth = next(i for i, m in enumerate(marks) if m in text)
    mark, finer = marks[depth], marks[depth + 1 :]
    if mark:
        head, *tail = text.split(mark)
        parts = [x for x in [head, *(mark + t for t in tail)] if x]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for part in parts:
        n = tokens(part)
        if n >= budget and finer:
            close()
            held, size = [], 0
            out += pieces(part, budget, overlap, finer)
            continue
        if held and size + n > budget:
            close()
            while held and (size > overlap or size + n > budget):
                size -= tokens(held.pop(0))
        held.append(part)
        size += n
    close()
    return out


def chunks(docs: DataFrame, budget: int = 1200, overlap: int = 120) -> DataFrame:
    """(doc_id, chunk_id, index, start, end, text, sec_id, role_hint, atomic_ref, tokens, overlap_prev) of documents (doc_id, text).

    sec_id is null for a text without headings; overlap_prev is the overlap for every part of a region but its first.
    Tables and figures are chunks of their own; the text between is cut by `pieces`, blank parts go. A part's place is the first
    where it occurs after the start of the part before it: in a text that repeats itself that may be an earlier copy. Sections and regions are
    expressions of one row; only the cutting itself runs in Python, in Arrow batches.
    """

    @F.pandas_udf("array<struct<at:int,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[dict]:
            at, out = 0, []
            for p in pieces(t, budget, overlap) if t.strip() else []:
                pos = max(t.find(p, at), 0)
                out.append({"at": pos, "text": p})
                at = pos + 1
            return out

        return texts.map(one)

    atom = lambda pattern, tag: F.transform(structure.found(F.col("text"), pattern), lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit(tag), i).alias("ref")))
    own = docs.select("doc_id", "text", F.posexplode(sections(F.col("text"))).alias("sec", "s"), F.concat(atom(structure.TABLE, "tbl-"), atom(structure.FIGURE, "fig-")).alias("atoms"))
    sec = F.when(F.col("s.name") != "body", F.concat(F.lit("sec-"), F.col("sec")))
    r = own.select("doc_id", sec.alias("sec_id"), "s.role_hint", F.explode(structure.regions(F.col("s.start"), F.col("s.end"), F.col("atoms"))).alias("r"), "text")
    r = r.select("doc_id", "sec_id", "role_hint", "r.start", "r.ref", F.substring(F.col("text"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("text"))
    whole = r.where("ref is not null").select("doc_id", "sec_id", "role_hint", "start", "ref", "text", F.lit(0).alias("overlap_prev"))
    parts = r.where("ref is null").select("doc_id", "sec_id", "role_hint", "start", "ref", F.posexplode(cut("text")).alias("k", "p")).select("doc_id", "sec_id", "role_hint", (F.col("start") + F.col("p.at")).alias("start"), "ref", "p.text", F.when(F.col("k") > 0, overlap).otherwise(0).alias("overlap_prev"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "text")) - 1
    return whole.union(parts).select("doc_id", F.concat(F.lit("chunk-"), index).alias("chunk_id"), index.alias("index"), "start", (F.col("start") + F.char_length("text")).alias("end"), "text", "sec_id", "role_hint", F.col("ref").alias("atomic_ref"), fn.count_tokens(F.col("text")).alias("tokens"), "overlap_prev")
