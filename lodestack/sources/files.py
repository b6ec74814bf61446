"""Files of a workspace as rows."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import EXTRA_SUFFIXES, LANGUAGES, is_indexable
from lodestack.sources.ignore import Ignore, read_rules, rerooted

IGNORE_FILES = (".gitignore", ".lodestackignore")


def gather_rules(root: str, base: list[str] | None = None) -> list[str]:
    """The rules given, those of the root's ignore files, and of each folder below; driver side, text files only."""
    rules = list(base or [])
    for folder, dirs, names in os.walk(root):
        dirs.sort()
        rel = os.path.relpath(folder, root)
        for name in IGNORE_FILES:
            if name in names:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                    rules += [rerooted(r, rel) for r in read_rules(f.read())]
        seen = Ignore(rules or None)
        dirs[:] = [d for d in dirs if not seen(os.path.normpath(os.path.join(rel, d)))]
    return rules


def wanted(paths: list[str], rules: list[str] | None = None) -> list[str]:
    """Those of some paths below a root that a walk of it would index: of a known suffix, and not ignored."""
    ignored, known = Ignore(rules or None), {*LANGUAGES, *EXTRA_SUFFIXES}
    return [p for p in paths if os.path.splitext(p)[1].lower() in known and not ignored(p)]


def read_files(spark: SparkSession, root: str, rules: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """source_file (relative to the root, or to its folder if it is a file), text; undecodable bytes become U+FFFD.
    With ``paths`` only those below the root are opened."""
    single = os.path.isfile(root)
    base = os.path.dirname(root) if single else root
    load = [root] if paths is None else [os.path.join(root, p) for p in paths]
    # a path is taken as it is, not as a pattern of names
    load = [re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in load]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(load)
    start = len(os.path.abspath(base).rstrip("/")) + 2
    local = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "%20", " ")
    files = raw.select(F.substr(local, F.lit(start)).alias("source_file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    ignore = Ignore(rules)

    @F.pandas_udf("boolean")
    def ignored(paths):
        return paths.map(ignore)

    kept = files.where(is_indexable(F.col("source_file")))
    return kept if single else kept.where(~ignored("source_file"))


def read_extraction(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of extraction files; a missing required field raises."""
    from lodestack.schemas import EXTRACTION

    doc = spark.read.schema(EXTRACTION).option("multiLine", "true").option("mode", "FAILFAST").json(path)

    def need(df: DataFrame, *fields: str) -> DataFrame:
        return df.withColumns({f: F.when(F.col(f).isNull(), F.raise_error(F.lit(f"missing field {f}"))).otherwise(F.col(f)) for f in fields})

    ent = need(doc.select(F.posexplode("entities").alias("ordinal", "e")).select("ordinal", "e.*"), "name", "entity_type")
    rel = need(doc.select(F.explode("relations").alias("r")).select("r.*"), "source_name", "source_type", "target_name", "target_type", "relation_type")
    return ent.withColumn("description", F.coalesce("description", F.lit(""))), rel.withColumn("evidence", F.coalesce("evidence", F.lit("")))
