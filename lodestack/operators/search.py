"""Exact vector search with scalar filters, and recall of observations.

Filters apply before the limit, the threshold after it, so fewer than ``limit``
rows may come out although more would qualify. An empty list of projects finds
nothing; an empty string is no filter. Ties in score go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.vectors import cosine
from lodestack.operators.current import current

CHUNK_FIELDS = ["id", "content", "source_file", "line_start", "line_end", "chunk_type", "language", "project"]
OBS_FIELDS = ["id", "content", "obs_type", "source", "project", "tags", "confidence", "valid_from", "valid_until"]


def in_projects(df: DataFrame, project: str | list[str] | None) -> DataFrame:
    if isinstance(project, list):
        return df.where(F.col("project").isin(project)) if project else df.where(F.lit(False))
    return df.where(F.col("project") == project) if project else df


def active(now: Column) -> Column:
    """Valid at ``now``: the start counts, the end doesn't; no end is forever."""
    return (F.col("valid_from") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") > now))


def _top(df: DataFrame, query: list[float], limit: int) -> DataFrame:
    scored = df.where(F.col("embedding").isNotNull()).withColumn("raw", cosine(F.col("embedding"), query)).where(F.col("raw").isNotNull())
    # NaN is the largest number here, but no similarity: it goes last
    return scored.orderBy(F.isnan("raw"), F.desc("raw"), "id").limit(limit)


def search_chunks(chunks: DataFrame, query: list[float], limit: int = 10, project: str | list[str] | None = None, chunk_type: str | None = None, threshold: float = 0.0) -> DataFrame:
    df = in_projects(chunks, project)
    if chunk_type:
        df = df.where(F.col("chunk_type") == chunk_type)
    top = _top(df, query, limit)
    return top.where(~(F.col("raw") < threshold) | F.isnan("raw")).select(*CHUNK_FIELDS, F.round("raw", 4).alias("score"))


def search_observations(obs: DataFrame, query: list[float], now: Column, limit: int = 10, project: str | list[str] | None = None, obs_type: str | None = None, active_only: bool = True) -> DataFrame:
    """No threshold: negative scores are returned."""
    df = in_projects(obs, project)
    if obs_type:
        df = df.where(F.col("obs_type") == obs_type)
    if active_only:
        df = df.where(active(now))
    return _top(df, query, limit).select(*OBS_FIELDS, F.round("raw", 4).alias("score"))


def _best_ids(df: DataFrame, query: list[float], limit: int) -> DataFrame:
    """id, raw of the best records of a table that may hold a record several times.

    Only ids and scores are shuffled, combined before; the wide columns are
    fetched for the few rows that come out."""
    scored = df.where(F.col("embedding").isNotNull()).select("id", cosine(F.col("embedding"), query).alias("raw")).where(F.col("raw").isNotNull())
    return scored.groupBy("id").agg(F.max("raw").alias("raw")).orderBy(F.isnan("raw"), F.desc("raw"), "id").limit(limit)


def search_repeated(df: DataFrame, query: list[float], limit: int, fields: list[str], stamp: str | None = None, threshold: float | None = None) -> DataFrame:
    """Top records of ``df``, whose copies agree but for ``stamp``, of which the latest is given."""
    best = _best_ids(df, query, limit)
    if threshold is not None:
        best = best.where(~(F.col("raw") < threshold) | F.isnan("raw"))
    kept = [*fields, *([stamp] if stamp and stamp not in fields else [])]
    rows = df.select(*kept).join(F.broadcast(best), "id")  # at most ``limit`` rows are broadcast
    return current(rows, stamp).select(*fields, F.round("raw", 4).alias("score"))


def search_batch(chunks: DataFrame, queries: dict[int, list[float]], limit: int = 5) -> DataFrame:
    """Several query vectors in one scan; ``queries`` is a driver-side list of a few."""
    each = F.array(*(F.struct(F.lit(k).cast("bigint").alias("query_id"), cosine(F.col("embedding"), q).alias("raw")) for k, q in queries.items()))
    flat = chunks.where(F.col("embedding").isNotNull()).select("id", F.inline(each)).where(F.col("raw").isNotNull() & ~F.isnan("raw"))
    flat = flat.groupBy("query_id", "id").agg(F.max("raw").alias("raw"))  # a record may come several times
    w = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "rank", "id", F.round("raw", 4).alias("score"))


def list_observations(obs: DataFrame, limit: int = 50, offset: int = 0, project: str | None = None, obs_type: str | None = None) -> DataFrame:
    """Newest first, expired ones too."""
    df = in_projects(obs, project)
    if obs_type:
        df = df.where(F.col("obs_type") == obs_type)
    return df.orderBy(F.desc("valid_from"), "id").offset(offset).limit(limit)
