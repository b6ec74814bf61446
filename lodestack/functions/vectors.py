"""Cosine similarity as a column expression, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(vec: Column, query: list[float]) -> Column:
    """Similarity to a constant vector; null unless ``vec`` has its length and holds
    numbers only, NaN where either is all zero."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = math.sqrt(sum(float(x) * float(x) for x in query))
    own = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    dot = F.aggregate(F.zip_with(vec, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    # a null or NaN in it shows in the sum
    sound = (F.size(vec) == len(query)) & own.isNotNull() & ~F.isnan(own)
    if norm == 0:
        return F.when(sound, F.lit(float("nan")))
    return F.when(sound & (own > 0), dot / (own * F.lit(norm))).when(sound, F.lit(float("nan")))
