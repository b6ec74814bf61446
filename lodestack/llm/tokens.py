"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.columns import pick
from lodestack.session import spread

#: Where the vocabulary lies on every executor; a parameter of all operators that need it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str = VOCABULARY):
    """Loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; null and empty ones have none, special tokens are ordinary text."""
    return len(encoding(path).encode_ordinary(text)) if text else 0


def sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and tokens; one row per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [count(t, path) for t in b["text"]]})

    rows = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return spread(rows).mapInPandas(run, "doc_id bigint, tokens bigint")
