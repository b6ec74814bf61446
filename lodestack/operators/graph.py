"""The graph of entities and relations: neighbours, orphans, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AmbiguousEntity(ValueError):
    """Several entities have the name asked for."""


def find_entities(entities: DataFrame, name: str, project: str | None = None) -> DataFrame:
    named = entities.where(F.lower("name") == name.lower())
    return named.where(F.col("project") == project) if project else named


def find_entity(entities: DataFrame, name: str, project: str | None = None):
    """The entity of a name whatever its case, of a project if one is given; None if there is none."""
    found = find_entities(entities, name, project).limit(2).collect()
    if len(found) > 1:
        raise AmbiguousEntity(name)
    return found[0] if found else None


def _ends(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("entity_type").alias("other_type"))


def outgoing(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relation, its source, and the entity it points to."""
    return relations.select(F.col("id").alias("relation_id"), F.col("source_id").alias("entity_id"), "relation_type", F.col("target_id").alias("other_id"), "weight", "evidence").join(_ends(entities), "other_id")


def incoming(relations: DataFrame, entities: DataFrame) -> DataFrame:
    return relations.select(F.col("id").alias("relation_id"), F.col("target_id").alias("entity_id"), "relation_type", F.col("source_id").alias("other_id"), "weight", "evidence").join(_ends(entities), "other_id")


def connections(chosen: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of the chosen entities in both directions; a self-loop shows twice. Relations are cut down
    to those first, and joined with the entities at their other ends once."""
    ids = chosen.select(F.col("id").alias("entity_id")).distinct()
    way = lambda mark, mine, other: F.struct(F.lit(mark).alias("direction"), F.col(mine).alias("entity_id"), F.col(other).alias("other_id"))
    ends = relations.select(F.col("id").alias("relation_id"), "relation_type", "weight", "evidence", F.inline(F.array(way("-->", "source_id", "target_id"), way("<--", "target_id", "source_id"))))
    return ends.join(ids, "entity_id", "left_semi").join(_ends(entities), "other_id")


def endpoints(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("source_id").alias("id")).union(relations.select(F.col("target_id").alias("id"))).distinct()


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that no relation touches."""
    return entities.join(endpoints(relations), "id", "left_anti")


def cascade(relations: DataFrame, deleted: DataFrame) -> DataFrame:
    """What is left of relations once entities (``id``) are deleted."""
    gone = deleted.select("id").distinct()
    return relations.join(gone, relations.source_id == gone.id, "left_anti").join(gone, relations.target_id == gone.id, "left_anti")


def k_hop(start: DataFrame, relations: DataFrame, hops: int) -> DataFrame:
    """Entities reached from ``start`` (id) along relations, with the least number of hops."""
    edges = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).distinct()
    seen = start.select("id", F.lit(0).alias("hops")).distinct()
    front = seen
    for h in range(1, hops + 1):
        front = front.select("id").join(edges, "id").select(F.col("to").alias("id"), F.lit(h).alias("hops")).distinct().join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(front)
    return seen.where("id is not null")


def upsert_entities(stored: DataFrame, batch: DataFrame, now) -> DataFrame:
    """The table after an import: ``batch`` has name, entity_type, description,
    source_file, chunk_id, project, ordinal. The key is name, type and project,
    nulls equal; the last of a batch wins, and chunk ids are appended if absent."""
    key = ["name", "entity_type", "project"]
    last = batch.groupBy(*key).agg(
        F.max_by(F.struct("description", "source_file"), "ordinal").alias("new"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id"))), lambda x: x["chunk_id"])).alias("added"),
    )
    n = last.select(*(F.col(k).alias(f"n_{k}") for k in key), "new", "added", F.lit(True).alias("is_new"))
    cond = (stored.name == n.n_name) & (stored.entity_type == n.n_entity_type) & stored.project.eqNullSafe(n.n_project)
    both = stored.withColumn("is_old", F.lit(True)).join(n, cond, "full_outer")
    none = F.array().cast("array<string>")
    added = F.filter(F.coalesce("added", none), lambda x: x.isNotNull())
    fresh = F.col("is_new").isNotNull()
    return both.select(
        F.coalesce("id", F.sha2(F.concat_ws("\x01", "n_name", "n_entity_type", F.coalesce("n_project", F.lit("\x02"))), 256)).alias("id"),
        *(F.when(F.col("is_old").isNotNull(), F.col(k)).otherwise(F.col(f"n_{k}")).alias(k) for k in key),
        F.when(fresh, F.coalesce("new.description", F.lit(""))).otherwise(F.col("description")).alias("description"),
        F.when(fresh, F.col("new.source_file")).otherwise(F.col("source_file")).alias("source_file"),
        F.struct(F.when(fresh, F.array_union(F.coalesce("properties.chunk_ids", none), added)).otherwise(F.col("properties.chunk_ids")).alias("chunk_ids"), F.col("properties.stale").alias("stale")).alias("properties"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select("id", "name", "entity_type", "description", "project", "source_file", "properties", "created_at", "updated_at")


def resolve_relations(batch: DataFrame, entities: DataFrame, project: str | None) -> DataFrame:
    """Relations of an import by the ids of their ends; those that name an unknown end are skipped.

    The smallest id stands for a key that is stored more than once."""
    here = entities.where(F.col("project").eqNullSafe(F.lit(project))).groupBy("name", "entity_type").agg(F.min("id").alias("id"))
    src = here.select(F.col("name").alias("source_name"), F.col("entity_type").alias("source_type"), F.col("id").alias("source_id"))
    dst = here.select(F.col("name").alias("target_name"), F.col("entity_type").alias("target_type"), F.col("id").alias("target_id"))
    return batch.join(src, ["source_name", "source_type"]).join(dst, ["target_name", "target_type"]).select(
        "source_id", "target_id", "relation_type", F.lit(1.0).alias("weight"), F.coalesce("evidence", F.lit("")).alias("evidence")
    )


def degree_ranked(entities: DataFrame, relations: DataFrame, most: int) -> DataFrame:
    """The entities with most edges; a report of ``most`` rows."""
    ends = relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return entities.join(ends, "id").orderBy(F.desc("degree"), "id").limit(most)




SHOWN_EVIDENCE, LISTED_EVIDENCE = 120, 80


def text(found: dict, evidence: int = SHOWN_EVIDENCE) -> str:
    """An entity and its edges (as ``Workspace.graph`` gives them) for reading, evidence cut to so many characters."""
    e = found["entity"]
    out = [f"{e['name']} ({e['entity_type']})", *([e["description"]] if e["description"] else [])]
    for way, mark in (("outgoing", "-->"), ("incoming", "<--")):
        for x in found.get(way, []):
            out.append(f"  {mark} {x['relation_type']} {x['other_name']} ({x['other_type']})")
            out += [f"      {x['evidence'][:evidence]}"] if x["evidence"] else []
    return "\n".join(out if len(out) > 1 or any(found.get(w) for w in ("outgoing", "incoming")) else [*out, "  (no edges)"])
