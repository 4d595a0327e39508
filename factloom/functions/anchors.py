"""Places of quoted words in a text, whatever white space is between them; all run inside the JVM. Offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import text as fn
from factloom.operators.structure import WORD

SPAN = "struct<start:int,end:int>"


def pattern(anchor: Column) -> Column:
    """A regular expression for an anchor's words with any white space between them; null for a blank anchor."""
    words = F.regexp_replace(fn.squeeze(anchor), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return fn.bind(words, lambda w: F.when(w != "", F.concat(F.lit("(?U)"), F.regexp_replace(w, " ", r"\\s+"))))


def _first(text: Column, anchor: Column, search_from: Column) -> Column:
    """The first match as a span. What matched is looked up as it stands: an earlier copy of it would have matched before."""
    hit = F.regexp_substr(F.substring(text, search_from + 1, F.char_length(text)), pattern(anchor))
    at = fn.bind(hit, lambda h: F.struct(F.position(h, text, search_from + 1).alias("at"), F.char_length(h).alias("n")))
    return fn.bind(at, lambda x: F.when(x["at"] > 0, F.struct((x["at"] - 1).alias("start"), (x["at"] - 1 + x["n"]).alias("end")).cast(SPAN)))


def find(text: Column, anchor: Column, search_from: Column | None = None, end_anchor: Column | None = None) -> Column:
    """struct<start,end> of an anchor's first place at or after `search_from`; null for a blank or absent anchor, never a guess.

    With an end anchor that follows it the span reaches to the end of that; one that is blank or absent changes nothing.
    """
    own = _first(text, anchor, F.lit(0) if search_from is None else search_from)
    if end_anchor is None:
        return own
    to = lambda x: F.coalesce(_first(text, end_anchor, x["end"])["end"], x["end"])
    return fn.bind(own, lambda x: F.when(x.isNotNull(), F.struct(x["start"].alias("start"), to(x).alias("end"))))


def verify_span(text: Column, start: Column, end: Column, anchor: Column | None = None) -> Column:
    """Whether a span lies inside the text, is not empty, and starts with the anchor if that is not blank. Nulls are false."""
    inside = (start >= 0) & (start < end) & (end <= F.char_length(text))
    if anchor is not None:
        begins = F.rlike(fn.slice_span(text, start, end), F.concat(F.lit("^"), pattern(anchor)))
        inside = inside & F.coalesce(begins, F.lit(True))
    return F.coalesce(inside, F.lit(False))


def window(text: Column, statement: Column, width: int = 700, words: int = 14, fallback: int = 1200) -> Column:
    """The `width` characters where most of a statement's first `words` words lie together, else the text's first `fallback` ones.

    Each word counts at its first place, words that repeat count again; of equally dense places the earliest word's is taken.
    """
    half = width // 2
    asked = F.slice(F.transform(F.regexp_extract_all(statement, F.lit(WORD), F.lit(0)), F.lower), 1, words)
    at = fn.bind(F.lower(text), lambda low: F.filter(F.transform(asked, lambda w: F.position(w, low) - 1), lambda p: p >= 0))
    near = lambda ps, p: F.size(F.filter(ps, lambda q: (q >= p - half) & (q <= p + half)))
    best = fn.bind(at, lambda ps: F.array_max(F.transform(ps, lambda p, i: F.struct(near(ps, p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"])
    cut = lambda p: F.substring(text, F.greatest(F.lit(0), p - half) + 1, p + half - F.greatest(F.lit(0), p - half))
    return F.coalesce(fn.bind(best, lambda p: F.when(p.isNotNull(), cut(p))), F.substring(text, 1, fallback), F.lit(""))
