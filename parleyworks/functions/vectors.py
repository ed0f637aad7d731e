"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(v: Column | str) -> Column:
    """Bytes of a vector with elements in -1..1: round(x * 127), halves up, clamped."""
    return F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * 127 + 0.5), F.lit(-127)), F.lit(127)).cast("int"))


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product, summed in order as doubles; null where the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def cosine_of_distance(d: Column | str) -> Column:
    """The cosine of two unit vectors at Euclidean distance ``d``."""
    d = F.col(d) if isinstance(d, str) else d
    return 1 - d * d / 2
