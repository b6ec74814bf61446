"""Queries over the knowledge store, with the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.functions.vectors import cosine
from lodestack.operators import aggregates as A
from lodestack.operators import chunking, context, graph, review, search, store
from lodestack import schemas as S
from lodestack.plans.bindings import ACTIVE_NOW, REVIEW_NOW, Tables, sql, stamp
from lodestack.session import scratch, written
from lodestack.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(statement: str | None = None):
    """Register a function of the bindings under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if statement is not None:
            SQL[f.__name__] = statement
        return f

    return add


# --- vectors --------------------------------------------------------------------------------------------------------

_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {0})"
_SOUND = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0"


def _raw(vec: int = 0) -> str:
    q, e = _Q.format(vec), "CAST(embedding AS DOUBLE[])"
    return f"list_inner_product({e}, {q}) / (sqrt(list_inner_product({e}, {e})) * sqrt(list_inner_product({q}, {q})))"


_CF = "id, content, source_file, line_start, line_end, chunk_type, language, project"
_OF = "id, content, obs_type, source, project, array_to_string(tags, ',') AS tags, confidence, valid_from, valid_until"


def _knn(where: str = "TRUE", k: int = 10, letter: str = "c", fields: str = _CF) -> str:
    return f"SELECT {fields}, round(raw, 4) AS score FROM (SELECT *, {_raw()} AS raw FROM {letter} WHERE {_SOUND} AND {where} ORDER BY raw DESC, id LIMIT {k})"


def _nearest(t: Tables, limit: int, where: str = "true") -> DataFrame:
    """Filters hold alike for all copies of a record, so they reach the scan."""
    return search.search_repeated(t.raw("chunks").where(where), t.query_vector(), limit, search.CHUNK_FIELDS, "indexed_at")


@query(sql("c", f"SELECT id, round({_raw()}, 4) AS score FROM c WHERE {_SOUND}"))
def cosine_scores(t: Tables) -> DataFrame:
    raw = cosine(F.col("embedding"), t.query_vector())
    scores = t.raw("chunks").where(F.col("embedding").isNotNull()).select("id", F.round(raw, 4).alias("score"))
    return scores.where(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("id").agg(F.max("score").alias("score"))


@query(sql("c", _knn()))
def knn_chunks(t: Tables) -> DataFrame:
    return _nearest(t, 10)


@query(sql("c", _knn("project = 'brimstack' AND chunk_type = 'code'")))
def knn_filtered(t: Tables) -> DataFrame:
    return _nearest(t, 10, "project = 'brimstack' AND chunk_type = 'code'")


@query(sql("c", f"SELECT * FROM ({_knn(k=40)}) WHERE score >= 0.3"))
def knn_threshold(t: Tables) -> DataFrame:
    top = _nearest(t, 40)
    return top.where(F.col("score") >= 0.3)  # above the limit, so it can't be pushed below it


@query(sql("o", _knn(f"valid_from <= TIMESTAMP '{ACTIVE_NOW}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{ACTIVE_NOW}')", letter="o", fields=_OF)))
def recall_observations(t: Tables) -> DataFrame:
    live = t.raw("observations").where(search.active(stamp(ACTIVE_NOW)))
    return search.search_repeated(live, t.query_vector(), 10, search.OBS_FIELDS).withColumn("tags", F.array_join("tags", ","))


_BATCH = " UNION ALL ".join(f"SELECT CAST({v} AS BIGINT) AS query_id, id, {_raw(v)} AS raw FROM c WHERE {_SOUND}" for v in (0, 1, 2))


@query(sql("c", f"SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(raw, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) AS rank FROM ({_BATCH})) WHERE rank <= 5"))
def knn_batch(t: Tables) -> DataFrame:
    return search.search_batch(t.raw("chunks"), t.query_vectors([0, 1, 2]), 5)


# --- filters --------------------------------------------------------------------------------------------------------


@query(sql("c", "SELECT id, source_file, project FROM c WHERE chunk_type = 'doc'"))
def chunks_by_type(t: Tables) -> DataFrame:
    return t.chunks.where(F.col("chunk_type") == "doc").select("id", "source_file", "project")


@query(sql("c", "SELECT id, source_file, project FROM c WHERE project IN ('brimstack', 'fernweld')"))
def chunks_in_projects(t: Tables) -> DataFrame:
    return search.in_projects(t.chunks, ["brimstack", "fernweld"]).select("id", "source_file", "project")


@query(sql("c", "SELECT id, source_file FROM c WHERE source_file LIKE 'src/%'"))
def chunks_path_prefix(t: Tables) -> DataFrame:
    return t.chunks.where(X.like_prefix(F.col("source_file"), "src/")).select("id", "source_file")


@query(sql("e", "SELECT id, name FROM e WHERE description IS NULL OR description = ''"))
def missing_descriptions(t: Tables) -> DataFrame:
    return t.entities.where(F.col("description").isNull() | (F.col("description") == "")).select("id", "name")


@query(sql("o", f"SELECT id, obs_type FROM o WHERE valid_from <= TIMESTAMP '{ACTIVE_NOW}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{ACTIVE_NOW}')"))
def active_observations(t: Tables) -> DataFrame:
    return t.observations.where(search.active(stamp(ACTIVE_NOW))).select("id", "obs_type")


@query(sql("o", "SELECT id, confidence FROM o WHERE confidence < 0.5"))
def low_confidence(t: Tables) -> DataFrame:
    return t.observations.where(F.col("confidence") < review.LOW_CONFIDENCE).select("id", "confidence")


@query(sql("o", f"SELECT id, valid_from FROM o WHERE valid_from < TIMESTAMP '{REVIEW_NOW}' - INTERVAL 90 DAY"))
def stale_observations(t: Tables) -> DataFrame:
    return t.observations.where(F.col("valid_from") < stamp(REVIEW_NOW) - F.expr("INTERVAL 90 DAYS")).select("id", "valid_from")


@query(sql("e", "SELECT id, name, entity_type, project FROM e WHERE lower(name) = lower('Oven_Bridge')"))
def entity_lookup_ci(t: Tables) -> DataFrame:
    return graph.find_entities(t.entities, "Oven_Bridge").select("id", "name", "entity_type", "project")


_LIST = "SELECT id, obs_type, source, project, confidence, valid_from, valid_until FROM o ORDER BY valid_from DESC, id LIMIT 50 OFFSET 10"


@query(sql("o", _LIST))
def list_observations(t: Tables) -> DataFrame:
    return search.list_observations(t.observations, 50, 10).select("id", "obs_type", "source", "project", "confidence", "valid_from", "valid_until")


# --- scalar functions -----------------------------------------------------------------------------------------------

_NAME = "regexp_extract(source_file, '([^/]*)$', 1)"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1))"
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items())
_CODE = ", ".join(f"'{k}'" for k in X.LANGUAGES if k not in X.DOC_SUFFIXES)
_ALL = ", ".join(f"'{k}'" for k in [*X.LANGUAGES, *X.EXTRA_SUFFIXES])


@query(f"SELECT DISTINCT source_file FROM chunks WHERE {_SUFFIX} IN ({_ALL})")
def suffix_filter(t: Tables) -> DataFrame:
    return t.raw("chunks").where(X.is_indexable(F.col("source_file"))).select("source_file").distinct()


@query(f"SELECT DISTINCT source_file, CASE {_SUFFIX} {_CASES} END AS detected, CASE WHEN {_SUFFIX} IN ({_CODE}) THEN 'code' ELSE 'doc' END AS kind FROM chunks")
def language_detect(t: Tables) -> DataFrame:
    f = F.col("source_file")
    return t.raw("chunks").select("source_file").distinct().select("source_file", X.language(f).alias("detected"), X.chunk_type(f).alias("kind"))


@query("SELECT doc_id, lang FROM documents WHERE length(trim(text, ' \t\r\n')) > 0")
def nonblank_docs(t: Tables) -> DataFrame:
    return t.raw("documents").where(F.length(F.trim(F.translate("text", "\n\r\t", "   "))) > 0).select("doc_id", "lang")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT DISTINCT name, lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) AS normal FROM entities")
def normalize_names(t: Tables) -> DataFrame:
    return t.raw("entities").select("name").distinct().select("name", X.normal_name(F.col("name")).alias("normal"))


@query(sql("c", "SELECT id, sha256(content)[:16] AS sum, checksum IS NOT DISTINCT FROM sha256(content)[:16] AS as_stored FROM c"))
def chunk_checksums(t: Tables) -> DataFrame:
    s = X.checksum(F.col("content"))
    return t.chunks.select("id", s.alias("sum"), F.col("checksum").eqNullSafe(s).alias("as_stored"))


_NL = "(length({0}) - length(replace({0}, chr(10), '')))"


@query(sql("c", f"SELECT id, CAST({_NL.format('content')} + 1 AS INTEGER) AS n_lines, CAST(line_start + {_NL.format('content')} AS INTEGER) AS line_last FROM c"))
def chunk_lines(t: Tables) -> DataFrame:
    n = X.newlines(F.col("content"))
    return t.chunks.select("id", (n + 1).alias("n_lines"), (F.col("line_start") + n).alias("line_last"))


_CUT = "trim(replace(content[1:{0}], chr(10), ' '), ' ')"


@query(sql("c", f"SELECT id, CASE WHEN length(content) > 200 THEN {_CUT.format(200)} || '...' ELSE {_CUT.format(200)} END AS preview, CASE WHEN coalesce(line_start, 0) <> 0 AND coalesce(line_end, 0) <> 0 THEN source_file || ':' || line_start || '-' || line_end ELSE source_file END AS place FROM c"))
def chunk_preview(t: Tables) -> DataFrame:
    return t.chunks.select("id", X.preview(F.col("content")).alias("preview"), X.location(F.col("source_file"), F.col("line_start"), F.col("line_end")).alias("place"))


@query(sql("c", f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN s > 0.3 THEN 'green' WHEN s > 0.1 THEN 'yellow' ELSE 'red' END AS band FROM (SELECT round({_raw()}, 4) AS s FROM c WHERE {_SOUND})) GROUP BY band"))
def score_bands(t: Tables) -> DataFrame:
    # shifted by 0.4, as few of these scores are above 0.5
    scores = cosine_scores(t).select(X.score_band(F.round(F.col("score") + 0.4, 4)).alias("band"))
    return scores.groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT id, list_aggregate(list_transform(string_split(joined, ','), lambda x: trim(x, ' ')), 'string_agg', '|') AS tags, len(string_split(joined, ',')) AS n FROM (SELECT DISTINCT id, array_to_string(tags, ' , ') AS joined FROM observations WHERE tags IS NOT NULL)")
def tags_split(t: Tables) -> DataFrame:
    rows = t.raw("observations").where("tags is not null").select("id", F.array_join("tags", " , ").alias("joined")).distinct()
    parts = X.tag_list(F.col("joined"))
    return rows.select("id", F.array_join(parts, "|").alias("tags"), F.size(parts).cast("bigint").alias("n"))


# --- chunk windows --------------------------------------------------------------------------------------------------

_WINDOWS = """
w AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 824)) AS off FROM documents WHERE length(trim(text, ' \t\r\n')) > 0),
x AS (SELECT doc_id, CAST(off // 824 AS INTEGER) AS pos, text[off + 1 : off + 1024] AS content, text[1 : off] AS head FROM w)"""


@query("WITH " + _WINDOWS.strip() + f" SELECT doc_id, pos, length(content) AS size, CAST({_NL.format('head')} + 1 AS INTEGER) AS line_start, CAST({_NL.format('head')} + 1 + {_NL.format('content')} AS INTEGER) AS line_end, sha256(content)[:16] AS checksum FROM x")
def chunk_windows(t: Tables) -> DataFrame:
    w = chunking.windows(t.raw("documents").select("doc_id", "text"), "text")
    return w.select("doc_id", "pos", F.length("content").cast("bigint").alias("size"), "line_start", "line_end", "checksum")


@query("WITH " + _WINDOWS.strip() + " SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id")
def chunk_count_per_doc(t: Tables) -> DataFrame:
    return chunking.windows(t.raw("documents").select("doc_id", "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n"))


# --- aggregates -----------------------------------------------------------------------------------------------------


@query(sql("cero", "SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM o) AS observations"))
def status_counts(t: Tables) -> DataFrame:
    return A.status_counts({"chunks": t.chunks, "entities": t.entities, "relations": t.relations, "observations": t.observations})


@query(sql("c", "SELECT count(*) AS n FROM c WHERE project = 'brimstack'"))
def count_chunks(t: Tables) -> DataFrame:
    return t.chunks.where("project = 'brimstack'").agg(F.count("*").alias("n"))


@query(sql("c", "SELECT coalesce(nullif(project, ''), '(none)') AS project, count(*) AS n FROM c GROUP BY 1"))
def chunks_by_project(t: Tables) -> DataFrame:
    return A.count_by(t.chunks, "project")


@query(sql("c", "SELECT coalesce(nullif(chunk_type, ''), '(none)') AS chunk_type, count(*) AS n FROM c GROUP BY 1"))
def chunks_by_chunk_type(t: Tables) -> DataFrame:
    return A.count_by(t.chunks, "chunk_type")


@query("SELECT count(DISTINCT source_file) AS n FROM chunks")
def distinct_files(t: Tables) -> DataFrame:
    return t.raw("chunks").agg(F.countDistinct("source_file").alias("n"))


@query("SELECT DISTINCT project FROM chunks WHERE project IS NOT NULL")
def indexed_projects(t: Tables) -> DataFrame:
    return t.raw("chunks").where("project is not null").select("project").distinct()


@query(sql("o", "SELECT coalesce(nullif(obs_type, ''), '(none)') AS obs_type, count(*) AS n FROM o GROUP BY 1"))
def obs_type_dist(t: Tables) -> DataFrame:
    return A.count_by(t.observations, "obs_type")


_OBS = f"SELECT count(*) AS n_obs, count(*) FILTER (obs_type = 'decision') AS n_decisions, count(*) FILTER (obs_type = 'warning') AS n_warnings, count(*) FILTER (confidence < 0.5) AS n_low, count(*) FILTER (valid_from < TIMESTAMP '{REVIEW_NOW}' - INTERVAL 90 DAY) AS n_stale FROM o"
_ENDS = "SELECT source_id AS id FROM r WHERE source_id IS NOT NULL UNION SELECT target_id FROM r WHERE target_id IS NOT NULL"
_ENT = f"SELECT count(*) AS n_entities, count(*) FILTER (description IS NULL OR description = '') AS n_bare, (SELECT count(*) FROM e WHERE id NOT IN ({_ENDS})) AS n_orphans FROM e"


@query(sql("ero", f"SELECT * FROM ({_OBS}), ({_ENT})"))
def review_counts(t: Tables) -> DataFrame:
    return review.observation_counts(t.observations, stamp(REVIEW_NOW)).join(review.entity_counts(t.entities, t.edges), F.lit(True))


@query(sql("ce", "SELECT n_entities, n_chunks, CASE WHEN n_entities > 0 AND n_chunks > 0 THEN round_even(n_entities / n_chunks, 3) END AS entity_chunk_ratio FROM (SELECT count(*) AS n_entities FROM e), (SELECT count(*) AS n_chunks FROM c)"))
def review_ratio(t: Tables) -> DataFrame:
    return review.ratio(t.chunks, t.entities)


_GAPS = "SELECT project, count(*) AS n_chunks FROM c WHERE project IS NOT NULL AND project NOT IN (SELECT project FROM e WHERE project IS NOT NULL) GROUP BY project"
_RULES = f"""
SELECT 'no_decisions' AS category, 'suggestion' AS severity, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS percent, CAST(NULL AS VARCHAR) AS project FROM k WHERE n_obs > 0 AND n_decisions = 0
UNION ALL SELECT 'no_warnings', 'info', 0, NULL, NULL FROM k WHERE n_obs > 0 AND n_warnings = 0
UNION ALL SELECT 'low_confidence', 'suggestion', n_low, NULL, NULL FROM k WHERE n_low > 0
UNION ALL SELECT 'staleness', 'info', n_stale, NULL, NULL FROM k WHERE n_stale > 0
UNION ALL SELECT 'orphans', CASE WHEN round_even(n_orphans * 100.0 / n_entities, 0) > 30 THEN 'suggestion' ELSE 'info' END, n_orphans, round_even(n_orphans * 100.0 / n_entities, 0), NULL FROM k WHERE n_entities > 0 AND n_orphans > 0
UNION ALL SELECT 'no_description', CASE WHEN round_even(n_bare * 100.0 / n_entities, 0) > 50 THEN 'suggestion' ELSE 'info' END, n_bare, round_even(n_bare * 100.0 / n_entities, 0), NULL FROM k WHERE n_entities > 0 AND n_bare > 0
UNION ALL SELECT 'coverage_gap', 'suggestion', n_chunks, NULL, project FROM g"""
_FINDINGS = (f"k AS (SELECT * FROM ({_OBS}), ({_ENT}))", f"g AS ({_GAPS})")


@query(sql("cero", _RULES, *_FINDINGS))
def review_findings(t: Tables) -> DataFrame:
    return review.findings(t.chunks, t.entities, t.edges, t.observations, stamp(REVIEW_NOW))


@query(sql("cero", f"SELECT count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'suggestion') AS suggestions, count(*) FILTER (severity = 'info') AS infos FROM ({_RULES})", *_FINDINGS))
def review_summary(t: Tables) -> DataFrame:
    return review.summary(review_findings(t))


@query(sql("ce", _GAPS))
def coverage_gaps(t: Tables) -> DataFrame:
    return review.coverage_gaps(t.chunks, t.entities)


@query(sql("ce", _GAPS.replace("FROM e WHERE", "FROM e WHERE entity_type = 'service' AND length(name) > 14 AND")))
def coverage_gaps_of_services(t: Tables) -> DataFrame:
    return review.coverage_gaps(t.chunks, t.entities.where("entity_type = 'service' AND length(name) > 14"))


@query(sql("c", "SELECT project, source_file, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(list_distinct(list(checksum))) AS x)), '') AS checksums, count(*) AS n_chunks FROM c GROUP BY project, source_file"))
def indexed_files(t: Tables) -> DataFrame:
    return A.indexed_files(t.chunks)


# --- pages and exports ----------------------------------------------------------------------------------------------

_PAGE = "SELECT * FROM c WHERE source_file LIKE 'src/%' ORDER BY source_file NULLS LAST, line_start NULLS LAST, id LIMIT 200 OFFSET 20"


@query(sql("c", f"SELECT id, source_file, line_start, language FROM ({_PAGE})"))
def export_page(t: Tables) -> DataFrame:
    return A.export_page(t.chunks, 200, 20, prefix="src/").select("id", "source_file", "line_start", "language")


@query(sql("c", f"SELECT coalesce(nullif(source_file, ''), '(unknown)') AS file, arg_min(coalesce(language, ''), (coalesce(line_start, 2147483647), id)) AS language, count(*) AS n_chunks, '[' || string_agg('\"' || id || '\"', ',' ORDER BY coalesce(line_start, 2147483647), id) || ']' AS chunk_ids FROM ({_PAGE}) GROUP BY 1"))
def export_by_file(t: Tables) -> DataFrame:
    return A.by_file(A.export_page(t.chunks, 200, 20, prefix="src/"))


@query(sql("c", "SELECT count(id) AS total FROM c WHERE source_file LIKE 'src/%'"))
def export_total(t: Tables) -> DataFrame:
    return t.chunks.where(X.like_prefix(F.col("source_file"), "src/")).agg(F.count("id").alias("total"))


# --- graph ----------------------------------------------------------------------------------------------------------

_HUB = "SELECT id FROM (SELECT unnest([source_id, target_id]) AS id FROM r) JOIN e USING (id) GROUP BY id ORDER BY count(*) DESC, id LIMIT 20"
_OUT = "SELECT r.id AS relation_id, r.source_id AS entity_id, r.relation_type, e.id AS other_id, e.name AS other_name, e.entity_type AS other_type FROM r JOIN e ON r.target_id = e.id"
_IN = "SELECT r.id AS relation_id, r.target_id AS entity_id, r.relation_type, e.id AS other_id, e.name AS other_name, e.entity_type AS other_type FROM r JOIN e ON r.source_id = e.id"
_EDGE = ["relation_id", "entity_id", "relation_type", "other_id", "other_name", "other_type"]


@query(sql("er", _OUT))
def graph_deps(t: Tables) -> DataFrame:
    return graph.outgoing(t.relations, t.entities).select(*_EDGE)


@query(sql("er", _IN))
def graph_dependents(t: Tables) -> DataFrame:
    return graph.incoming(t.relations, t.entities).select(*_EDGE)


@query(sql("r", _ENDS))
def edge_endpoints(t: Tables) -> DataFrame:
    return graph.endpoints(t.edges).where("id is not null")


@query(sql("er", f"SELECT id, name, entity_type FROM e WHERE id NOT IN ({_ENDS})"))
def orphan_entities(t: Tables) -> DataFrame:
    return graph.orphans(t.entities, t.edges).select("id", "name", "entity_type")


@query(sql("er", "SELECT r.id AS relation_id FROM r WHERE r.source_id NOT IN (SELECT id FROM e WHERE entity_type = 'config') AND r.target_id NOT IN (SELECT id FROM e WHERE entity_type = 'config')"))
def cascade_edges(t: Tables) -> DataFrame:
    rel = t.relations.where("source_id is not null and target_id is not null")
    return graph.cascade(rel, t.entities.where("entity_type = 'config'")).select(F.col("id").alias("relation_id"))


@query(sql("er", """SELECT id, CAST(min(hops) AS INTEGER) AS hops FROM (
  SELECT id, 0 AS hops FROM h
  UNION ALL SELECT a.target_id, 1 FROM h JOIN r a ON a.source_id = h.id
  UNION ALL SELECT b.target_id, 2 FROM h JOIN r a ON a.source_id = h.id JOIN r b ON b.source_id = a.target_id) WHERE id IS NOT NULL GROUP BY id""", f"h AS ({_HUB})"))
def graph_khop(t: Tables) -> DataFrame:
    hubs = graph.degree_ranked(t.entities, t.relations, 20)
    return graph.k_hop(hubs, t.edges, 2)


# --- context --------------------------------------------------------------------------------------------------------

_TOP = f"top AS ({_knn()})"
_NEAR = "near AS (SELECT * FROM e WHERE source_file IN (SELECT source_file FROM top WHERE source_file IS NOT NULL))"


def _top(t: Tables) -> DataFrame:
    return _nearest(t, 10)


@query(sql("ce", "SELECT id, name, source_file FROM near", _TOP, _NEAR))
def context_entities(t: Tables) -> DataFrame:
    return context.context_entities(t.entities, _top(t)).select("id", "name", "source_file")


@query(sql("cer", f"SELECT '-->' AS direction, * FROM ({_OUT}) WHERE entity_id IN (SELECT id FROM near) UNION ALL SELECT '<--', * FROM ({_IN}) WHERE entity_id IN (SELECT id FROM near)", _TOP, _NEAR))
def context_connections(t: Tables) -> DataFrame:
    near = context.context_entities(t.entities, _top(t))
    return graph.connections(near, t.relations, t.entities).select("direction", *_EDGE)


@query(sql("c", "SELECT coalesce(nullif(project, ''), '(untagged)') AS project, count(*) AS n FROM top GROUP BY 1", _TOP))
def project_distribution(t: Tables) -> DataFrame:
    return context.project_distribution(_top(t))


@query(sql("ce", "SELECT id, source_file FROM c WHERE source_file NOT IN (SELECT source_file FROM e WHERE source_file IS NOT NULL)"))
def unextracted_chunks(t: Tables) -> DataFrame:
    return A.unextracted(t.chunks, t.entities).where("source_file is not null").select("id", "source_file")


_NAMES = ["brimstack", "Fern-Weld", "orin lake", "DOVE_TRAIL", "nothing_here", "tallowgate"]
_NORM = "lower(replace(replace(replace({0}, ' ', ''), '-', ''), '_', ''))"


@query(
    f"WITH n AS (SELECT unnest({_NAMES!r}) AS name), p AS (SELECT DISTINCT project FROM chunks WHERE project IS NOT NULL), x AS (SELECT name AS project FROM n INTERSECT SELECT project FROM p) "
    f"SELECT project FROM x UNION SELECT min(p.project) FROM n JOIN p ON {_NORM.format('name')} = {_NORM.format('p.project')} WHERE name NOT IN (SELECT project FROM x) GROUP BY name"
)
def workspace_match(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return A.match_projects(names, t.raw("chunks"))


_PLACE = "CASE WHEN coalesce(line_start, 0) <> 0 AND coalesce(line_end, 0) <> 0 THEN source_file || ':' || line_start || '-' || line_end ELSE source_file END"
_LIVE = f"valid_from <= TIMESTAMP '{ACTIVE_NOW}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{ACTIVE_NOW}')"


@query(sql("cero", f"""SELECT 'chunk' AS section, id, {_PLACE} AS label, CAST(score AS VARCHAR) AS detail FROM top
 UNION ALL SELECT 'entity', id, name, entity_type FROM near
 UNION ALL SELECT 'connection', relation_id, '--> ' || other_name, relation_type FROM ({_OUT}) WHERE entity_id IN (SELECT id FROM near)
 UNION ALL SELECT 'connection', relation_id, '<-- ' || other_name, relation_type FROM ({_IN}) WHERE entity_id IN (SELECT id FROM near)
 UNION ALL SELECT 'observation', id, obs_type, CAST(score AS VARCHAR) FROM ({_knn(_LIVE, 5, "o", _OF)})""", f"top AS ({_knn(k=5)})", _NEAR))
def context_bundle(t: Tables) -> DataFrame:
    """Chunks, entities, connections and observations for one task, as one table."""
    q = t.query_vector()
    # a few rows each, asked for several times; of the chunks there are five at most
    best = search.search_repeated(t.raw("chunks"), q, 5, search.CHUNK_FIELDS, "indexed_at")
    top = t.spark.createDataFrame(best.collect(), best.schema)
    near = written(t.entities_in(top.where("source_file is not null").select("source_file"), "source_file"), "near")
    edges = written(t.relations_of(near), "edges")
    ends = t.entities_in(edges.select(F.explode(F.array("source_id", "target_id")).alias("id")), "id")
    obs = search.search_repeated(t.raw("observations").where(search.active(stamp(ACTIVE_NOW))), q, 5, search.OBS_FIELDS)
    return context.bundle_rows(context.Context(top, near, graph.connections(near, edges, ends), obs))


# --- changes of tables, as the new snapshot -------------------------------------------------------------------------

_DELETED = "SELECT DISTINCT project, source_file FROM chunks WHERE project = 'fernweld' AND source_file LIKE 'src/%'"
_KEPT = f"NOT EXISTS (SELECT 1 FROM ({_DELETED}) d WHERE d.source_file = c.source_file AND d.project IS NOT DISTINCT FROM c.project)"


def _deleted(t: Tables) -> DataFrame:
    return t.raw("chunks").where("project = 'fernweld' AND source_file LIKE 'src/%'").select("project", "source_file").distinct()


@query(sql("c", f"SELECT id, project, source_file FROM c WHERE {_KEPT}"))
def delete_by_file(t: Tables) -> DataFrame:
    return store.delete_files(t.chunks, _deleted(t)).select("id", "project", "source_file")


@query(sql("c", f"SELECT id, project, source_file FROM c WHERE {_KEPT} UNION ALL SELECT 'new-' || source_file, project, source_file FROM ({_DELETED})"))
def replace_by_file(t: Tables) -> DataFrame:
    gone = _deleted(t)
    new = gone.select(F.concat(F.lit("new-"), "source_file").alias("id"), "project", "source_file")
    return store.replace_files(t.chunks.select("id", "project", "source_file"), gone, new)


@query(sql("e", "SELECT id, coalesce(source_file LIKE 'src/%', FALSE) OR coalesce(properties.stale, FALSE) AS stale, coalesce(len(properties.chunk_ids), 0) AS n_chunk_ids FROM e"))
def mark_stale(t: Tables) -> DataFrame:
    gone = t.raw("entities").where("source_file LIKE 'src/%'").select("source_file")
    props = F.col("properties")
    return store.mark_stale(t.entities, gone).select("id", F.coalesce(props["stale"], F.lit(False)).alias("stale"), F.coalesce(F.array_size(props["chunk_ids"]), F.lit(0)).cast("bigint").alias("n_chunk_ids"))


_DISK = "SELECT DISTINCT project, source_file FROM chunks WHERE indexed_at < TIMESTAMP '2026-01-01 00:00:00'"


@query(f"SELECT project, source_file FROM (SELECT DISTINCT project, source_file FROM chunks) i WHERE NOT EXISTS (SELECT 1 FROM ({_DISK}) k WHERE k.source_file = i.source_file AND k.project IS NOT DISTINCT FROM i.project)")
def stale_files(t: Tables) -> DataFrame:
    raw = t.raw("chunks")
    return store.stale_files(raw, raw.where("indexed_at < TIMESTAMP_NTZ '2026-01-01 00:00:00'"))


@query(sql("o", "SELECT id, CASE WHEN obs_type = 'pattern' THEN 'patched' ELSE content END AS content, CASE WHEN obs_type = 'pattern' THEN 0.75 ELSE confidence END AS confidence, CASE WHEN obs_type = 'pattern' THEN FALSE ELSE embedding IS NOT NULL END AS embedded FROM o"))
def observation_patch(t: Tables) -> DataFrame:
    patches = t.observations.where("obs_type = 'pattern'").select("id", F.lit("patched").alias("content"), F.lit(0.75).alias("confidence"))
    return store.patch_observations(t.observations, patches).select("id", "content", "confidence", F.col("embedding").isNotNull().alias("embedded"))


@query(sql("o", f"SELECT id, CASE WHEN obs_type = 'warning' THEN TIMESTAMP '{ACTIVE_NOW}' ELSE valid_until END AS valid_until FROM o"))
def observation_invalidate(t: Tables) -> DataFrame:
    return store.invalidate(t.observations, t.observations.where("obs_type = 'warning'"), stamp(ACTIVE_NOW)).select("id", "valid_until")


_BATCH_ENT = """b AS (SELECT name, entity_type, project, arg_max(description, (updated_at, id)) AS description, arg_max(coalesce(source_file, '?'), (updated_at, id)) AS source_file FROM e
 WHERE entity_type IN ('function', 'class') GROUP BY name, entity_type, project
 UNION ALL SELECT 'imported ' || project, 'module', project, 'new', '?' FROM (SELECT DISTINCT project FROM e WHERE project IS NOT NULL))"""


def _import_batch(t: Tables) -> DataFrame:
    old = t.entities.where("entity_type IN ('function', 'class')")
    order = F.struct("updated_at", "id")
    again = old.select("name", "entity_type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("source_file", F.lit("?")).alias("source_file"), F.lit("added-chunk").alias("chunk_id"), "project", order.alias("ordinal"))
    new = t.entities.where("project is not null").select("project").distinct().select(
        F.concat(F.lit("imported "), "project").alias("name"), F.lit("module").alias("entity_type"), F.lit("new").alias("description"), F.lit("?").alias("source_file"), F.lit("added-chunk").alias("chunk_id"), "project",
        F.struct(stamp(ACTIVE_NOW).alias("updated_at"), F.lit("x").alias("id")).alias("ordinal"),
    )
    return again.unionByName(new)


@query(sql("e", """SELECT coalesce(e.name, b.name) AS name, coalesce(e.entity_type, b.entity_type) AS entity_type, CASE WHEN e.id IS NULL THEN b.project ELSE e.project END AS project,
 CASE WHEN b.name IS NOT NULL THEN coalesce(b.description, '') ELSE e.description END AS description, CASE WHEN b.name IS NOT NULL THEN b.source_file ELSE e.source_file END AS source_file, e.id IS NULL AS inserted, e.created_at, CASE WHEN b.name IS NOT NULL THEN NULL ELSE e.updated_at END AS unchanged_since,
 coalesce(array_to_string(list_sort(CASE WHEN b.name IS NULL THEN e.properties.chunk_ids ELSE list_distinct(list_concat(coalesce(e.properties.chunk_ids, []), ['added-chunk'])) END), ','), '') AS chunk_ids
 FROM e FULL JOIN b ON e.name = b.name AND e.entity_type = b.entity_type AND e.project IS NOT DISTINCT FROM b.project""", _BATCH_ENT.replace("arg_max(description,", "arg_max(coalesce(description, ''),")))
def entity_upsert(t: Tables) -> DataFrame:
    now = t.entities.select("id").withColumn("old", F.lit(True))
    after = graph.upsert_entities(t.entities, _import_batch(t), stamp(ACTIVE_NOW))
    fresh = F.array_contains("properties.chunk_ids", "added-chunk")
    ids = F.array_join(F.array_sort("properties.chunk_ids"), ",")
    return after.join(now, "id", "left").select(
        "name", "entity_type", "project", "description", "source_file", F.col("old").isNull().alias("inserted"), F.when(F.col("old"), F.col("created_at")).alias("created_at"),
        F.when(~F.coalesce(fresh, F.lit(False)), F.col("updated_at")).alias("unchanged_since"), F.coalesce(ids, F.lit("")).alias("chunk_ids"),
    )


@query(sql("er", """SELECT s.id AS source_id, g.id AS target_id, x.relation_type, CAST(1.0 AS DOUBLE) AS weight FROM x
 JOIN k s ON s.name = x.source_name AND s.entity_type = x.source_type JOIN k g ON g.name = x.target_name AND g.entity_type = x.target_type""",
 "k AS (SELECT name, entity_type, min(id) AS id FROM e WHERE project = 'brimstack' GROUP BY name, entity_type)",
 "x AS (SELECT a.name AS source_name, a.entity_type AS source_type, b.name AS target_name, b.entity_type AS target_type, r.relation_type FROM r JOIN e a ON a.id = r.source_id JOIN e b ON b.id = r.target_id)"))
def relation_resolve(t: Tables) -> DataFrame:
    a = t.entities.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("entity_type").alias("source_type"))
    b = t.entities.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("entity_type").alias("target_type"))
    batch = t.relations.join(a, "source_id").join(b, "target_id").select("source_name", "source_type", "target_name", "target_type", "relation_type", "evidence")
    return graph.resolve_relations(batch, t.entities, "brimstack").drop("evidence")


# --- change feeds ---------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts, seq) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM file_events),
 s AS (SELECT *, sum(first) OVER (PARTITION BY path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS burst FROM g)
 SELECT path, arg_max(lower(action), (ts, seq)) AS action, max(ts) AS ts, count(*) AS n_events FROM s GROUP BY path, burst""")
def debounce_last_action(t: Tables) -> DataFrame:
    return changes.debounced(t.raw("file_events"), "30 minutes")


_TOUCHED = "SELECT DISTINCT path FROM file_events WHERE ts >= TIMESTAMP '2026-01-01 00:00:00'"


_LAST = "SELECT path, arg_max(lower(action), (ts, seq)) AS action FROM file_events WHERE ts >= TIMESTAMP '2026-01-01 00:00:00' GROUP BY path"


@query(sql("c", f"SELECT id, project, source_file FROM c WHERE CASE WHEN project IS NULL THEN source_file ELSE project || '/' || source_file END NOT IN ({_TOUCHED}) UNION ALL SELECT 'new-' || path, NULL, path FROM ({_LAST}) WHERE action <> 'delete'"))
def delta_apply(t: Tables) -> DataFrame:
    """What was deleted loses its chunks, what was made or modified gets new ones."""
    actions = changes.last_actions(t.raw("file_events").where("ts >= TIMESTAMP_NTZ '2026-01-01 00:00:00'"))
    new = actions.where("action <> 'delete'").select(F.concat(F.lit("new-"), "path").alias("id"), F.lit(None).cast("string").alias("project"), F.col("path").alias("source_file"))
    return changes.apply_changes(t.chunks.select("id", "project", "source_file"), actions, new)


# --- answers as JSON and text ---------------------------------------------------------------------------------------


def _json(fields: list[str]) -> str:
    return "to_json({" + ", ".join(f"{f}: {f}" for f in fields) + "})"


_QUERY_FIELDS = ["content", "source_file", "line_start", "line_end", "chunk_type", "language", "project", "id"]


@query(sql("c", f"SELECT id, {_json(_QUERY_FIELDS)}::VARCHAR AS result, score FROM ({_knn()})"))
def query_json(t: Tables) -> DataFrame:
    """Each result of a question as the machine-readable answer has it, nulls named."""
    return _nearest(t, 10).select("id", F.to_json(F.struct(*_QUERY_FIELDS), {"ignoreNullFields": "false"}).alias("result"), "score")


@query(sql("o", f"SELECT id, strftime(valid_from, '%Y-%m-%dT%H:%M:%S') AS valid_from, strftime(valid_until, '%Y-%m-%dT%H:%M:%S') AS valid_until, coalesce(metadata, '{{}}') AS metadata, printf('%.0f%%', round(confidence * 100, 0)) AS confidence FROM o"))
def observation_texts(t: Tables) -> DataFrame:
    """Times as ISO text, an absent bag as an empty one, shares in percent."""
    stamp_ = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return t.observations.select("id", stamp_("valid_from"), stamp_("valid_until"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), X.percent_text(F.col("confidence"), 0).alias("confidence"))


@query(sql("c", f"SELECT id, printf('%.2f%%', round(score * 100, 2)) AS similarity FROM ({_knn(k=50)})"))
def similarity_texts(t: Tables) -> DataFrame:
    return _nearest(t, 50).select("id", X.percent_text(F.col("score"), 2).alias("similarity"))


@query(sql("r", "SELECT id, coalesce(evidence, '')[1:120] AS shown, coalesce(evidence, '')[1:80] AS listed FROM r"))
def evidence_cuts(t: Tables) -> DataFrame:
    e = F.col("evidence")
    return t.relations.select("id", X.clipped(e, graph.SHOWN_EVIDENCE).alias("shown"), X.clipped(e, graph.LISTED_EVIDENCE).alias("listed"))


@query(sql("ce", "SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM e) AS entities, (SELECT count(DISTINCT source_file) FROM c) AS files, (SELECT count(DISTINCT project) FROM c) AS projects"))
def status_report(t: Tables) -> DataFrame:
    c = t.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("files"), F.countDistinct("project").alias("projects"))
    return c.join(t.entities.agg(F.count("*").alias("entities")), F.lit(True))  # one row each


@query(sql("e", "SELECT id, name, entity_type, project FROM e WHERE lower(name) IN (SELECT lower(name) FROM e GROUP BY 1 HAVING count(DISTINCT project) > 1) AND project = 'brimstack'"))
def entity_lookup_in_project(t: Tables) -> DataFrame:
    """Names that several projects have, resolved within one."""
    e = t.entities
    several = e.groupBy(F.lower("name").alias("low")).agg(F.countDistinct("project").alias("n")).where("n > 1")
    return e.where("project = 'brimstack'").join(several, F.lower("name") == F.col("low"), "left_semi").select("id", "name", "entity_type", "project")


@query(sql("o", "SELECT id, content, obs_type, project FROM o UNION ALL SELECT 'added-' || project, 'noted', 'fact', project FROM (SELECT DISTINCT project FROM o WHERE project IS NOT NULL)"))
def observation_append(t: Tables) -> DataFrame:
    """Notes added to a table of versions, read back from it."""
    from lodestack.operators.store import Store

    s = Store(t.spark, scratch(t.spark, "store"))
    s.create()
    old = t.observations
    s.write("observations", old)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in S.OBSERVATIONS}
    said = {"id": F.concat(F.lit("added-"), "project"), "content": F.lit("noted"), "obs_type": F.lit("fact"), "project": F.col("project")}
    s.append("observations", old.where("project is not null").select("project").distinct().select(*(said.get(n, c).alias(n) for n, c in none.items())))
    return s.read("observations").select("id", "content", "obs_type", "project")


@query(sql("ce", "SELECT count(*) FILTER (source_file IN (SELECT source_file FROM g)) AS chunks_deleted, (SELECT count(*) FROM g) AS stale_files, (SELECT count(*) FROM e WHERE source_file IN (SELECT source_file FROM g)) AS entities_marked_stale FROM c",
 "g AS (SELECT DISTINCT source_file FROM chunks WHERE source_file LIKE 'src/util/%')"))
def prune_counts(t: Tables) -> DataFrame:
    gone = t.raw("chunks").where("source_file LIKE 'src/util/%'").select("source_file").distinct()
    return (
        t.chunks.join(gone, "source_file", "left_semi").agg(F.count("*").alias("chunks_deleted")).join(gone.agg(F.count("*").alias("stale_files")), F.lit(True))
        .join(store.mark_stale(t.entities.withColumn("properties", F.lit(None).cast(S.PROPERTIES)), gone).agg(F.count_if("properties.stale").alias("entities_marked_stale")), F.lit(True))
    )


@query(sql("c", f"""SELECT coalesce(nullif(source_file, ''), '(unknown)') AS file, count(*) AS n, string_agg(id, ',' ORDER BY coalesce(line_start, 2147483647), id) AS chunk_ids FROM ({_PAGE}) GROUP BY 1"""))
def export_contract(t: Tables) -> DataFrame:
    """Files of a page of an export with the ids importers refer to."""
    page = A.export_page(t.chunks, 200, 20, prefix="src/")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("line_start", F.lit(2147483647)).alias("line"), F.col("id").alias("chunk_id"))))
    return page.groupBy(X.none_label(F.col("source_file"), "(unknown)").alias("file")).agg(F.count("*").alias("n"), F.array_join(F.transform(order, lambda x: x["chunk_id"]), ",").alias("chunk_ids"))
