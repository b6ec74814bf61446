"""Counts for status reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import like_prefix, none_label


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: a count per table."""
    parts = [df.select(F.lit(name).alias("t")) for name, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*(F.count_if(F.col("t") == n).alias(n) for n in tables))


def count_by(df: DataFrame, column: str, label: str = "(none)") -> DataFrame:
    return df.groupBy(none_label(F.col(column), label).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def export_rows(chunks: DataFrame, project: str | None = None, prefix: str | None = None) -> DataFrame:
    """The chunks an export pages through."""
    df = chunks.where(F.col("project") == project) if project else chunks
    return df.where(like_prefix(F.col("source_file"), prefix)) if prefix else df


def export_page(chunks: DataFrame, limit: int = 200, offset: int = 0, project: str | None = None, prefix: str | None = None) -> DataFrame:
    """A page of chunks in the order of file and line, unknown lines last."""
    df = export_rows(chunks, project, prefix)
    return df.orderBy(F.asc_nulls_last("source_file"), F.asc_nulls_last("line_start"), "id").offset(offset).limit(limit)


def by_file(page: DataFrame) -> DataFrame:
    """One row per file of a page (bounded by its limit): its chunks in order, the language of the first."""
    order = F.struct(F.coalesce("line_start", F.lit(2147483647)).alias("line"), "id", F.coalesce("language", F.lit("")).alias("language"))
    return page.groupBy(none_label(F.col("source_file"), "(unknown)").alias("file")).agg(
        F.min_by(F.coalesce("language", F.lit("")), order).alias("language"), F.count("*").alias("n_chunks"),
        F.to_json(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["id"])).alias("chunk_ids"),
    )


def indexed_files(chunks: DataFrame) -> DataFrame:
    """The set of checksums of each file; a file stays even if it has none."""
    return chunks.groupBy("project", "source_file").agg(F.concat_ws(",", F.sort_array(F.collect_set("checksum"))).alias("checksums"), F.count("*").alias("n_chunks"))


def unextracted(chunks: DataFrame, entities: DataFrame, project: str | None = None) -> DataFrame:
    """Chunks of files that no entity names."""
    known = entities.where(F.col("project") == project) if project else entities
    files = known.where(F.col("source_file").isNotNull()).select("source_file").distinct()
    return (chunks.where(F.col("project") == project) if project else chunks).join(files, "source_file", "left_anti")


def match_projects(names: DataFrame, indexed: DataFrame) -> DataFrame:
    """Directory names that are indexed projects: those equal, then of the rest those
    equal but for case, blanks, ``-`` and ``_``; of several the smallest."""
    from lodestack.functions.text import normal_name

    projects = indexed.where(F.col("project").isNotNull()).select("project").distinct()
    exact = names.select(F.col("name").alias("project")).intersect(projects)
    rest = names.select("name").distinct().join(exact.withColumnRenamed("project", "name"), "name", "left_anti")
    keyed = projects.groupBy(normal_name(F.col("project")).alias("key")).agg(F.min("project").alias("project"))
    loose = rest.select(normal_name(F.col("name")).alias("key")).join(keyed, "key").select("project")
    return exact.union(loose).distinct().orderBy("project")
