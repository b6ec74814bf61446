"""Splitting oversized texts at natural boundaries.

A text over ``limit`` characters is cut by a hierarchy of separators: section,
paragraph, line, sentence, word, character. A unit that doesn't fit is cut by
the next level; units are then packed greedily. A full piece ends at the best boundary of its last
part, from ``FILL`` of the limit on, so that it doesn't end within a paragraph whose border lies there. Each piece starts with a
tail of the one before, of at most ``overlap`` characters, that itself starts
at the best boundary there is. Where a text has no blanks, marks of code stand
between its words.

Characters are code points. Cases: a null content is no text; a repeated id is
split once; a text of exactly ``limit`` characters is not oversized; a text
without any boundary is cut by characters, with the whole overlap; line numbers that are swapped are
put in order, and where the first is unknown it follows from the last, or is
1 if both are. Extra columns are never read. Each text is one row: the work
spreads over rows and nothing is shuffled but the ids, to drop repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators.columns import pick

LIMIT, OVERLAP = 1024, 200
FILL = 0.6

#: Places where a unit of each level may start, best first. A match's end is the place.
LEVELS = [
    re.compile(r"\n(?=\#{1,6} |=+ |(?:class|def|func|function|export|public|struct|type|interface|CREATE)\b)"),
    re.compile(r"\n[ \t\r]*\n\s*?(?=\S)|\n[ \t\r]*\n"),
    re.compile(r"\n"),
    re.compile(r"[.!?;:…。！？][\"'”’)\]]*\s+|[;}]+(?=[^\s;},)])"),  # sentences, and statements
    re.compile(r"\s+"),
    re.compile(r"[,{})\]|&]+|(?=\\[^\s\\])"),  # code and strings without blanks: behind marks, before escapes
]


def _cuts(text: str, lo: int, hi: int, level: int, limit: int, overlap: int, out: list[tuple[int, int]]) -> None:
    """Append to ``out`` the ends of units of [lo, hi) that fit, with the level of the separator there."""
    if hi - lo <= limit:
        out.append((hi, level))
        return
    if level == len(LEVELS):
        step = limit - overlap  # leaves room for the tail of the piece before
        out.extend((min(at + step, hi), level) for at in range(lo, hi, step))
        return  # the caller knows what is at the end
    ends = [m.end() for m in LEVELS[level].finditer(text, lo, hi) if lo < m.end() < hi]
    for start, end in zip([lo, *ends], [*ends, hi]):
        _cuts(text, start, end, level + 1, limit, overlap, out)
        if end < hi:
            out[-1] = (end, level)


def _tail(text: str, start: int, end: int, most: int) -> int:
    """Where the overlap before ``end`` starts: the best boundary in the last ``most`` characters."""
    lo = max(start + 1, end - most)
    if lo >= end:
        return end
    for rx in LEVELS:
        at = next((m.end() for m in rx.finditer(text, max(0, lo - 2), end) if lo <= m.end() < end), None)
        if at is not None:
            return at
    return lo


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans [start, end) that cover ``text`` in order, each at most ``limit`` long."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if not text:
        return []
    cuts: list[tuple[int, int]] = []
    _cuts(text, 0, len(text), 0, limit, overlap, cuts)
    out, start, first, i = [], 0, 0, 0  # the piece begins at ``start``, its own units with number ``first``
    while i < len(cuts):
        if cuts[i][0] - start <= limit:
            i += 1
            continue
        late = [k for k in range(first, i) if cuts[k][0] - start >= FILL * limit] or [i - 1]
        k = min(late, key=lambda k: (cuts[k][1], -k))
        last = cuts[k][0]
        out.append((start, last))
        first = i = k + 1
        # the tail must leave room for the unit that comes next
        start = _tail(text, start, last, min(overlap, limit - (cuts[i][0] - last)))
    out.append((start, len(text)))
    return out


def split_rows(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                text = r.content
                total = text.count("\n")
                known = [int(x) for x in (r.line_start, r.line_end) if not pd.isna(x)]
                if len(known) == 2 or not pd.isna(r.line_start):
                    first = min(known)
                else:
                    first = max(1, known[0] - total) if known else 1
                at, line = 0, first
                for n, (lo, hi) in enumerate(pieces(text, limit, overlap), 1):
                    line += text.count("\n", at, lo) if lo >= at else -text.count("\n", lo, at)
                    at = lo
                    inside = text.count("\n", lo, hi)
                    # a break that ends the piece starts no line of it
                    inside -= text[hi - 1] == "\n"
                    rows.append((r.chunk_id, n, lo, hi, text[lo:hi], r.source_file, line, line + inside))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    return run


PIECE_SCHEMA = "chunk_id string, piece_no int, char_start int, char_end int, content string, source_file string, line_start int, line_end int"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of every chunk longer than ``limit`` characters."""
    return (
        pick(chunks, "id", "content", "source_file", "line_start", "line_end").where((F.length("content") > limit) & F.col("id").isNotNull())
        .select(F.col("id").alias("chunk_id"), "content", "source_file", F.col("line_start").cast("double"), F.col("line_end").cast("double"))
        .dropDuplicates(["chunk_id"])
        .mapInPandas(split_rows(limit, overlap), PIECE_SCHEMA)
    )


def oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids of the chunks that had to be split, read off their pieces."""
    return split_oversized(chunks, limit, overlap).where("piece_no = 1").select("chunk_id")
