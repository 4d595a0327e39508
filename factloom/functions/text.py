"""Scalar functions over texts, headings, names and quantities; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import vocab

#: fixed values: a section number before a heading; references to arXiv by id and by address; numbers with a unit
ROMAN_OR_NUMBER = r"(?i)^(?:[ivxlcdm]+|\d+(?:\.\d+)*|[a-z])[.)]?\s+"
ARXIV_ID, ARXIV_URL = r"(?i)^(?:arxiv:)?\d{4}\.\d{4,5}(?:v\d+)?$", r"(?i)arxiv\.org/(?:abs|html|pdf)/\d{4}\.\d{4,5}"
UNIT = r"(?iu)\d+(?:\.\d+)?\s*(?:W|kW|V|mV|A|mA|sccm|nm|µm|um|mm|cm|Å|K|°C|℃|µbar|ubar|bar|Pa|kPa|MPa|GPa|Torr|rpm|Hz|kHz|MHz|GHz|min|mins|hr|h|ms|eV|meV|wt%|at%|%)\b"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row: a lambda over an array of one element binds it, where Spark would put the
    whole expression at each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def detect_lang(text: Column) -> Column:
    """ru if Cyrillic letters outnumber Latin ones in the first 4000 characters, en otherwise, null without either."""
    head = F.substring(text, 1, 4000)
    cyr, lat = F.regexp_count(head, F.lit("[\\u0400-\\u04FF]")), F.regexp_count(F.lower(head), F.lit("[a-z]"))
    return F.when(cyr > lat, "ru").when(lat > 0, "en").when(cyr > 0, "en")


def needs_ocr(text: Column, pages: Column) -> Column:
    n = F.char_length(text)
    return (pages <= 0) | (n / F.greatest(pages, F.lit(1)) < 100) | (F.regexp_count(text, F.lit(r"\p{L}")) / F.greatest(n, F.lit(1)) < 0.5)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_heading(name: Column) -> Column:
    """White space to one blank, the leading section number off (also words of roman letters, as the model has it), lower case, no colon at the end."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(squeeze(name), ROMAN_OR_NUMBER, ""))), ":+$", "")


def role_hint(name: Column) -> Column:
    """The prior of the whole normalised heading, else of the first prior, in their order, that it holds as words."""
    table = F.create_map(*[F.lit(x) for kv in vocab.SECTION_PRIORS for x in kv])

    def hint(norm: Column) -> Column:
        first = F.coalesce(*[F.when(norm.rlike(rf"\b{key}\b"), F.lit(role)) for key, role in vocab.SECTION_PRIORS])
        return F.when(norm != "", F.coalesce(F.try_element_at(table, norm), first))

    return bind(norm_heading(name), hint)


def is_heading(line: Column) -> Column:
    def check(s: Column) -> Column:
        words = F.size(F.split(squeeze(s), " "))
        prior = norm_heading(s).isin([k for k, _ in vocab.SECTION_PRIORS])
        numbered = s.rlike(r"^\d+(\.\d+)*\.?\s+\S")
        capitals = (F.upper(s) == s) & (F.lower(s) != s) & (words <= 8)
        return (s != "") & (F.char_length(s) <= 80) & (words <= 12) & (prior | numbered | capitals)

    return bind(F.trim(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")), check)


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(name)), r"\s+", "-"), 1, 80)


def key(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), slug(name))


def slice_span(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def snippet(text: Column, start: Column, end: Column, around: int = 160, most: int = 600) -> Column:
    """The span with `around` characters on both sides, trimmed, `most` at most; empty without a span."""
    lo = F.greatest(F.lit(0), start - around)
    hi = F.least(F.char_length(text), end + around)
    cut = F.trim(F.substring(F.substring(text, lo + 1, hi - lo), F.lit(1), F.lit(most)))  # greatest and least pass over nulls
    return F.coalesce(F.when(start.isNotNull() & end.isNotNull(), cut), F.lit(""))


def number(value: Column) -> Column:
    """A double as text: its digits as Java finds them (before Java 19 a few values have one more than they need), a point, and an
    exponent only below 1e-4 and from 1e16 on."""

    def plain(s: Column) -> Column:
        part = lambda n: F.regexp_extract(s, r"^(-?)(\d)\.(\d+)E(-?\d+)$", n)
        e, tail = part(4).cast("int"), F.regexp_replace(part(3), "^0$", "")
        digits = F.concat(part(2), tail)
        whole = F.concat(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), F.coalesce(F.nullif(F.substring(digits, e + 2, F.char_length(digits)), F.lit("")), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        science = F.concat(part(2), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(e).cast("string"))), F.lit("0")))
        return F.when(~s.contains("E"), s).otherwise(F.concat(part(1), F.when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small).otherwise(science)))

    return bind(value.cast("double").cast("string"), plain)


def quantity(raw: Column, op: Column, value: Column, unit: Column) -> Column:
    """The quantity as it was written, else operator, value and unit, else nothing."""
    made = F.trim(F.concat(F.coalesce(op, F.lit("")), number(value), F.lit(" "), F.coalesce(unit, F.lit(""))))
    return F.coalesce(F.when(raw != "", raw), made, F.lit(""))


def entity_text(name: Column, aliases: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(name), aliases), lambda x: x.isNotNull() & (F.trim(x) != ""))), " ; ")


def conceptual(name: Column) -> Column:
    """Not blank, at most 8 words, fewer than 2 numbers with a unit."""
    return F.coalesce((F.trim(name) != "") & (F.size(F.split(squeeze(name), " ")) <= 8) & (F.size(F.regexp_extract_all(name, F.lit(UNIT), F.lit(0))) < 2), F.lit(False))


def layout_category(label: Column) -> Column:
    """Ordered rules over a layout detector's label."""
    s = F.lower(label)
    has = lambda *ks: F.greatest(*[s.contains(k) for k in ks]) if len(ks) > 1 else s.contains(ks[0])
    drop = ("figure", "image", "chart", "formula", "equation", "header", "footer", "number", "seal", "stamp", "watermark", "aside")  # fixed values
    return F.when(has("table") & ~has("title", "caption"), "table").when(has("title") & ~has("table", "figure", "chart", "image"), "title").when(has(*drop), "drop").otherwise("text")


def route(ref: Column) -> Column:
    """The source adapter of a reference: arXiv ids and addresses first, then PDF files; null for others."""

    def adapter(s: Column) -> Column:
        return F.when(s.rlike(ARXIV_ID) | s.rlike(ARXIV_URL), "arxiv").when(F.lower(s).endswith(".pdf"), "pdf")

    return bind(F.regexp_replace(ref, r"(?U)^\s+|\s+$", ""), adapter)


def cluster(node: Column, source: Column) -> Column:
    """The folder letter of a node: from its id, else from its source, else X."""
    own, given = F.regexp_extract(node, r"^pub_([a-f])\d*$", 1), F.regexp_extract(F.coalesce(source, F.lit("")), r"pub_([a-f])\d*", 1)
    return F.upper(F.coalesce(F.nullif(own, F.lit("")), F.nullif(given, F.lit("")), F.lit("x")))
