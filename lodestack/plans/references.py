"""Queries of the reference check, with the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.operators import references as R
from lodestack.plans.bindings import canon_sql as _canon
from lodestack.session import table


def _references(spark: SparkSession, d: str) -> R.References:
    return R.References(*(table(spark, d, n) for n in ("relations", "entities", "chunks", "removals", "file_events")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).orphans()


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).counts()


_TIME = """CASE WHEN regexp_matches(x, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN try_cast(x AS TIMESTAMPTZ)
 ELSE try_cast(x || 'Z' AS TIMESTAMPTZ) END"""

P1_SQL = f"""
WITH rel AS (
  SELECT {_canon("id")} AS record_id, source_id, target_id, json_extract_string(metadata, '$.extracted_at') AS x FROM relations
), relt AS (SELECT record_id, source_id, target_id, epoch_us({_TIME}) AS us FROM rel),
raw AS (
  SELECT 'relations' AS ref_table, 'source_id' AS ref_field, record_id, {_canon("source_id")} AS ref_key, 'entity' AS kind, {_canon("source_id")} AS key, us FROM relt WHERE source_id IS NOT NULL
  UNION ALL
  SELECT 'relations', 'target_id', record_id, {_canon("target_id")}, 'entity', {_canon("target_id")}, us FROM relt WHERE target_id IS NOT NULL
  UNION ALL
  SELECT 'entities', 'chunk_ids', {_canon("id")}, {_canon("k")}, 'chunk', {_canon("k")}, epoch_us(updated_at)
  FROM (SELECT id, updated_at, unnest(properties.chunk_ids) AS k FROM entities) WHERE k IS NOT NULL
  UNION ALL
  SELECT 'entities', 'source_file', {_canon("id")}, source_file, 'file', coalesce(project, '?none') || '|' || source_file, epoch_us(updated_at)
  FROM entities WHERE source_file <> ''
), refs AS (
  SELECT ref_table, ref_field, record_id, ref_key, kind, key, min(us) AS us FROM raw GROUP BY ALL
), there AS (
  SELECT kind, key, min(us) AS us FROM (
    SELECT 'entity' AS kind, {_canon("id")} AS key, epoch_us(created_at) AS us FROM entities
    UNION ALL SELECT 'chunk', {_canon("id")}, epoch_us(indexed_at) FROM chunks
    UNION ALL SELECT 'file', coalesce(project, '?none') || '|' || source_file, epoch_us(indexed_at) FROM chunks
  ) GROUP BY ALL
), gone AS (
  SELECT DISTINCT CASE WHEN record_table = 'entities' THEN 'entity' ELSE 'chunk' END AS kind, {_canon("record_id")} AS key FROM removals
  UNION SELECT 'file', '?none|' || path FROM file_events WHERE lower(action) = 'delete'
  UNION SELECT 'file', regexp_replace(path, '^([^/]+)/', '\\1|') FROM file_events WHERE lower(action) = 'delete' AND regexp_matches(path, '^[^/]+/')
), found AS (
  SELECT ref_table, ref_field, record_id, ref_key,
    CASE WHEN t.key IS NULL AND g.key IS NOT NULL THEN 'deleted' WHEN t.key IS NULL THEN 'missing' WHEN t.us > refs.us THEN 'late' END AS ref_state,
    coalesce(strftime(make_timestamp(refs.us), '%Y-%m'), 'unknown') AS ref_month
  FROM refs LEFT JOIN there t USING (kind, key) LEFT JOIN gone g USING (kind, key)
), p1 AS (SELECT DISTINCT * FROM found WHERE ref_state IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_orphan_counts": p1_orphan_counts}
SQL = {
    "p1_found": P1_SQL + "SELECT * FROM p1",
    "p1_orphan_counts": P1_SQL
    + "SELECT ref_table, ref_field, ref_month, ref_state, count(*) AS n_references FROM p1 GROUP BY ALL",
}
