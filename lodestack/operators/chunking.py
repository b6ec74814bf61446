"""Cutting texts into chunks.

``windows`` is the fixed form, in built-in functions only: windows of ``size``
characters, a new one every ``size - overlap``. ``chunk_files`` is the form for
whole files: code is packed by blocks that a blank line or a dedent ends,
prose by sentences that overlap, both to ``size`` characters; the splitters are
approximations of syntax- and token-based ones and keep only their invariants
(order, limit, no blank chunk, line numbers that are true).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as X

SIZE, OVERLAP = 1024, 200
#: Languages whose files are cut as code.
CODE_LANGUAGES = {"python", "javascript", "typescript", "go", "rust", "java", "c", "cpp", "c_sharp", "ruby", "php", "swift", "kotlin", "scala", "bash", "sql", "css"}


def windows(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The rows of ``df`` with ``pos``, ``content``, ``line_start``, ``line_end``, ``checksum``; blank texts give none."""
    step = size - overlap
    t = F.col(text)
    cut = df.where(F.length(F.trim(F.translate(t, "\n\r\t", "   "))) > 0).select("*", F.posexplode(F.sequence(F.lit(0), F.length(t) - 1, F.lit(step))).alias("pos", "_at"))
    cut = cut.withColumn("content", F.substr(t, F.col("_at") + 1, F.lit(size)))
    first = X.newlines(F.substr(t, F.lit(1), F.col("_at"))) + 1
    return cut.withColumn("line_start", first).withColumn("line_end", F.col("line_start") + X.newlines(F.col("content"))).withColumn("checksum", X.checksum(F.col("content"))).drop("_at")


def _blocks(text: str, language: str | None) -> list[str]:
    if language in CODE_LANGUAGES:
        return [p for p in re.split(r"(?<=\n)(?=\n*\S)(?<=\n\n)|(?<=\n)(?=(?:def|class|func|function|export|public|struct|type|CREATE)\b)", text) if p]
    return [p for p in re.split(r"(?<=[.!?])(?=\s)|(?<=\n\n)", text) if p]


def chunk_text(text: str, language: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters. Of prose each begins with the last sentences of the one
    before, as many as ``overlap`` holds; code isn't repeated but where a block has no boundary."""
    blocks = []
    for block in _blocks(text, language):
        while len(block) > size:  # no boundary within the limit: fixed windows
            blocks.append((block[:size], False))
            block = block[size - overlap :]
        blocks.append((block, True))
    out, current, again = [], [], language not in CODE_LANGUAGES
    for block, whole in blocks:
        if current and (sum(map(len, current)) + len(block) > size or not whole):
            out.append("".join(current))
            tail = []
            while again and whole and current and sum(map(len, tail)) + len(current[-1]) <= min(overlap, size - len(block)):
                tail.insert(0, current.pop())
            current = tail
        current.append(block)
        if not whole:
            out.append(block)
            current = []
    out.append("".join(current))
    return [c for c in out if c.strip()]


def located(text: str, chunks: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Each chunk with its lines; the search for one starts behind the one before."""
    out, cursor = [], 0
    for c in chunks:
        at = text.find(c, cursor)
        if at < 0:
            out.append((c, None, None))
            continue
        start = text.count("\n", 0, at) + 1
        out.append((c, start, start + c.count("\n")))
        cursor = at + 1
    return out


CHUNKED = "source_file string, content string, line_start int, line_end int"


def chunk_files(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """source_file, text -> chunks with lines, type, language and checksum."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, c, a, z) for p, t, lang in zip(b["source_file"], b["text"], b["language"]) if t and t.strip() for c, a, z in located(t, chunk_text(t, lang, size, overlap))]
            out = pd.DataFrame(rows, columns=["source_file", "content", "line_start", "line_end"])
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    path = F.col("source_file")
    named = files.select("source_file", "text", X.language(path).alias("language"))
    return named.mapInPandas(run, CHUNKED).withColumns({"chunk_type": X.chunk_type(path), "language": X.language(path), "checksum": X.checksum(F.col("content"))})
