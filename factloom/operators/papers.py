"""Whole papers: regions of a layout put together, and the parts of a text in one record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators import sections, structure


def _strip(c):
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def place(regions: DataFrame) -> DataFrame:
    """regions (paper_ref, n, category, text) with texts trimmed, blank ones gone, and `start`, `end` in the paper's text, where
    they follow one another with one line break between. One window a paper."""
    r = regions.select("paper_ref", "n", "category", _strip(F.col("text")).alias("text")).where("text <> ''")
    total = F.sum(F.char_length("text") + 1).over(Window.partitionBy("paper_ref").orderBy("n"))
    return r.withColumn("end", total - 1).withColumn("start", F.col("end") - F.char_length("text"))


def assemble_sections(regions: DataFrame) -> DataFrame:
    """(paper_ref, sec_id, name, role_hint, start, end): from each title to the next one. Text before the first title is
    'frontmatter'; a paper without titles is one 'body', an empty one if it has no text at all."""
    r = place(regions)
    total = r.groupBy("paper_ref").agg(F.max("end").alias("total"), F.min(F.when(F.col("category") == "title", F.col("start"))).alias("first"))
    whole = regions.select("paper_ref").distinct().join(total, "paper_ref", "left")
    front = whole.where("first is null or first > 0").select("paper_ref", F.when(F.col("first").isNull(), "body").otherwise("frontmatter").alias("name"), F.lit(None).cast("string").alias("role_hint"), F.lit(0).cast("long").alias("start"), F.coalesce("first", "total", F.lit(0)).alias("end"))
    nxt = F.lead("start").over(Window.partitionBy("paper_ref").orderBy("n"))
    own = r.where("category = 'title'").withColumn("next", nxt).join(total, "paper_ref").select("paper_ref", F.substring(fn.squeeze(F.col("text")), 1, 80).alias("name"), fn.role_hint(F.col("text")).alias("role_hint"), "start", F.coalesce("next", "total").alias("end"))
    n = F.row_number().over(Window.partitionBy("paper_ref").orderBy("start")) - 1
    return front.unionByName(own).select("paper_ref", F.concat(F.lit("sec-"), n).alias("sec_id"), "name", "role_hint", "start", "end")


def assemble_tables(regions: DataFrame) -> DataFrame:
    """(paper_ref, tbl_id, caption, start, end) of the regions that are tables; captions are the first 120 characters."""
    n = F.row_number().over(Window.partitionBy("paper_ref").orderBy("n")) - 1
    return place(regions).where("category = 'table'").select("paper_ref", F.concat(F.lit("tbl-"), n).alias("tbl_id"), F.substring("text", 1, 120).alias("caption"), "start", "end")


def assemble_text(regions: DataFrame) -> DataFrame:
    """(paper_ref, raw_text) of the same regions."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return place(regions).groupBy("paper_ref").agg(F.array_join(texts, "\n").alias("raw_text"))


def extract_text(pages: DataFrame, force_ocr: bool = False, lang: str | None = None) -> DataFrame:
    """(paper_ref, raw_text, n_pages, ocr_used, lang) of pages (paper_ref, page, text): texts follow one another without a separator;
    ocr_used tells that optical recognition is asked for or needed; a language that is named goes before the one found."""
    own = pages.groupBy("paper_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("raw_text"), F.count(F.lit(1)).alias("n_pages"))
    need = F.lit(True) if force_ocr else fn.needs_ocr(F.col("raw_text"), F.col("n_pages"))
    return own.select("paper_ref", "raw_text", "n_pages", need.alias("ocr_used"), F.lit(lang).alias("lang") if lang else fn.detect_lang(F.col("raw_text")).alias("lang"))


def load_layout(pages: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, sections and tables of papers whose pages (paper_ref, page, ...) a detector turns into regions (paper_ref, page, ord, label,
    text): figures, formulas, headers and the like go, the rest is put together in the order of pages."""
    found = detect(pages).withColumn("category", fn.layout_category(F.col("label"))).where("category <> 'drop'")
    regions = found.select("paper_ref", F.struct("page", "ord").alias("n"), "category", "text")
    return assemble_text(regions), assemble_sections(regions), assemble_tables(regions)


def load(docs: DataFrame) -> DataFrame:
    """(paper_ref, source, title, year, raw_text, text_hash, parsed, meta) of documents (paper_ref, source, text, n_pages).

    parsed: sections, tables, figures and refs as arrays; meta: n_pages, n_chars, n_tokens, lang, structure_reliable. A title
    stays empty and a year null: a text alone tells neither. All in one row: no shuffle and no Python.
    """
    t = F.col("text")
    spans = lambda pattern, tag: F.transform(structure.found(t, pattern), lambda m, i: F.struct(F.concat(F.lit(tag), i).alias("ref"), m["start"].alias("start"), m["end"].alias("end"), F.trim(F.substring_index(F.substring(t, m["start"] + 1, F.lit(140)), "\n", 1)).alias("caption")))
    parsed = F.struct(sections.sections(t).alias("sections"), spans(structure.TABLE, "tbl-").alias("tables"), spans(structure.FIGURE, "fig-").alias("figures"), structure.reference_lines(t).alias("refs"))
    own = docs.select("paper_ref", "source", F.coalesce("text", F.lit("")).alias("text"), "n_pages")
    own = own.select("*", parsed.alias("parsed"))
    headings = F.size(F.filter("parsed.sections", lambda s: ~s["name"].isin("body", "frontmatter")))
    meta = F.struct("n_pages", F.char_length(t).cast("long").alias("n_chars"), fn.count_tokens(t).alias("n_tokens"), fn.detect_lang(t).alias("lang"), (headings >= 3).alias("structure_reliable"))
    return own.select("paper_ref", "source", F.lit("").alias("title"), F.lit(None).cast("int").alias("year"), t.alias("raw_text"), F.sha1("text").alias("text_hash"), "parsed", meta.alias("meta"))
