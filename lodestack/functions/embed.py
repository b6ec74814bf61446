"""Embedding texts: a deterministic hashing embedder, and how any other plugs in."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

DIMENSIONS = 64
_WORD = re.compile(r"\w+")
Embedder = Callable[[str], list[float]]


def hashing_embedder(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Signed counts of hashed words and word pairs, of length 1; zeros for a text without words."""
    v = [0.0] * dimensions
    words = _WORD.findall(text.lower())
    for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        h = zlib.crc32(w.encode())
        v[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def embed(df: DataFrame, text: str = "content", make: Callable[[], Embedder] | None = None) -> DataFrame:
    """``df`` with ``embedding``; ``make`` loads a model, once per Python worker and partition."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema if f.name != "embedding"] + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
    base = df.drop("embedding") if "embedding" in df.columns else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make() if make else hashing_embedder
        for b in batches:
            b["embedding"] = [None if t is None else model(t) for t in b[text]]
            yield b

    return base.mapInPandas(run, schema)
