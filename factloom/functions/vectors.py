"""Vector arithmetic over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The length; 1 for a zero vector."""
    return bind(F.sqrt(dot(a, a)), lambda n: F.when(n == 0, 1.0).otherwise(n))


def unit(a: Column) -> Column:
    """a, as doubles, over its length, which is worked out once."""
    return bind(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector has norm 1 here, so its cosine is 0."""
    return dot(a, b) / (norm(a) * norm(b))


def blend(name: Column, context: Column, weight: float = 0.7) -> Column:
    """weight * name + (1 - weight) * context, both scaled to length 1 first."""
    return F.zip_with(unit(name), unit(context), lambda x, y: x * weight + y * (1 - weight))


def hash_embedding(text: Column) -> Column:
    """64 numbers from the SHA-256 of the trimmed, lower-cased text: its bytes twice, over 255, as a unit vector."""

    def spread(digest: Column) -> Column:
        half = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)
        return unit(F.concat(half, half))

    return bind(F.sha2(F.lower(F.trim(text)), 256), spread)
