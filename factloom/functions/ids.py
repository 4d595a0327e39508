"""Ids as bytes: what is shuffled of a hex digest takes half of its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX, TEXT = bytearray(b"\x01"), bytearray(b"\x00")
ALL = 2**31 - 1


def pack(name: str | Column) -> Column:
    """An id as bytes, lower-case hex digits two a byte. Different ids stay different; their order does not stay."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.rlike("^(?:[0-9a-f]{2}){8,}$"), F.concat(F.lit(HEX), F.unhex(c))).otherwise(F.concat(F.lit(TEXT), c.cast("binary")))


def unpack(name: str | Column) -> Column:
    """The id that `pack` made bytes of."""
    c = F.col(name) if isinstance(name, str) else name
    body = F.substring(c, 2, ALL)
    return F.when(F.substring(c, 1, 1) == F.lit(HEX), F.lower(F.hex(body))).otherwise(body.cast("string"))


def digest(*columns: str | Column) -> Column:
    """12 bytes of values, null told from all others: of a billion different ones two are alike with a probability of 1e-11."""
    said = [F.col(c) if isinstance(c, str) else c for c in columns]
    whole = said[0] if len(said) == 1 else F.to_json(F.array(*[c.cast("string") for c in said]), {"ignoreNullFields": "false"})
    return F.substring(F.unhex(F.md5(whole.cast("string"))), 1, 12)


def least(packed: str) -> Column:
    """The aggregate that is the first of packed ids in the order of their texts: digits and other texts keep theirs each."""
    c = F.col(packed)
    hexed = F.substring(c, 1, 1) == F.lit(HEX)
    return F.least(unpack(F.min(F.when(hexed, c))), unpack(F.min(F.when(~hexed, c))))
