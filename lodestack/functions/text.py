"""Scalar expressions over names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that are indexed, the language each names, and which of them are documents.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".sh": "bash", ".bash": "bash", ".sql": "sql", ".html": "html", ".css": "css", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".json": "json", ".md": "markdown", ".rst": "rst", ".txt": "text",
}
DOC_SUFFIXES = [".yaml", ".yml", ".toml", ".json", ".md", ".rst", ".txt"]
EXTRA_SUFFIXES = [".txt", ".cfg", ".ini"]


def suffix(path: Column) -> Column:
    """The last dot and what follows it, in lower case; empty for hidden files and names without a dot."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def chunk_type(path: Column) -> Column:
    known = suffix(path).isin(list(LANGUAGES)) & ~suffix(path).isin(DOC_SUFFIXES)
    return F.when(known, "code").otherwise("doc")


def is_indexable(path: Column) -> Column:
    return suffix(path).isin([*LANGUAGES, *EXTRA_SUFFIXES])


def normal_name(c: Column) -> Column:
    return F.lower(F.translate(c, " -_", ""))


def checksum(c: Column) -> Column:
    """First 16 hex digits of SHA-256 over UTF-8."""
    return F.left(F.sha2(c, 256), F.lit(16))


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def preview(c: Column, size: int = 200) -> Column:
    cut = F.trim(F.translate(F.substring(c, 1, size), "\n", " "))
    return F.when(F.length(c) > size, F.concat(cut, F.lit("..."))).otherwise(cut)


def clipped(c: Column, size: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, size)


def score_band(score: Column) -> Column:
    return F.when(score > 0.7, "green").when(score > 0.5, "yellow").otherwise("red")


def location(path: Column, start: Column, end: Column) -> Column:
    """file:start-end where both lines are known and not zero, else the file."""
    known = (F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0)
    return F.when(known, F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(path)


def tag_list(c: Column) -> Column:
    """Parts between commas, without their blanks; empty ones stay."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x))


def like_prefix(c: Column, prefix: str) -> Column:
    """LIKE with the prefix as given: its ``_`` and ``%`` are wildcards, a backslash is itself."""
    return c.like(prefix.replace("\\", "\\\\") + "%")


def none_label(c: Column, label: str = "(none)") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(label))


def percent_text(share: Column, digits: int = 2) -> Column:
    """A share as percents with so many digits."""
    return F.format_string(f"%.{digits}f%%", F.round(share * 100, digits))


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves to even; null over nothing."""
    return F.bround(F.try_divide(part * 100.0, whole), 0)
