"""What several operators say about texts and keys, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def key_of(*cols: Column) -> Column:
    """One text, never null, that differs whenever the columns do, null included."""
    return F.to_json(F.array(*[c.cast("string") for c in cols]))


def order_key(seed: int, *cols: Column) -> Column:
    """A seeded 64-bit number of the columns, of which the upper 60 bits are the MD5's first: SQL engines can do the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return ((F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") - F.lit(2**59)) * F.lit(16)).cast("long")


def order_key_sql(seed: int, *cols: str) -> str:
    """order_key in DuckDB's SQL, up to the factor."""
    return f"('0x' || md5('{seed}|' || " + " || '|' || ".join(f"coalesce({c}::varchar, 'null')" for c in cols) + ")[1:15])::bigint"


def source_key(source: Column) -> Column:
    """Orders as the source by code point with null last: texts start with a low character, null with a high one."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))
