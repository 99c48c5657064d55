"""Vector arithmetic on array columns, summed from left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def index_score(cos) -> Column:
    """A cosine on the 0 to 1 scale that vector indexes report."""
    return (1 + col(cos)) / 2


def from_index(score) -> Column:
    return F.round(2 * col(score) - 1, 4)
