"""The context of a task: best chunks, entities of their files, edges, observations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import location, none_label
from lodestack.operators.graph import connections
from lodestack.operators.search import in_projects, search_chunks, search_observations


@dataclass
class Context:
    chunks: DataFrame
    entities: DataFrame
    connections: DataFrame
    observations: DataFrame
    projects: DataFrame | None = None


def context_entities(entities: DataFrame, chunks: DataFrame, project: str | list[str] | None = None) -> DataFrame:
    """Entities of the files of the chosen chunks (at most a limit's worth of files)."""
    files = F.broadcast(chunks.where(F.col("source_file").isNotNull()).select("source_file").distinct())
    return in_projects(entities, project).join(files, "source_file", "left_semi")


def build_context(chunks: DataFrame, entities: DataFrame, relations: DataFrame, obs: DataFrame, query: list[float], now: Column, limit: int = 5, project: str | list[str] | None = None) -> Context:
    """With several projects twice as much is taken and the share of each is told."""
    many = isinstance(project, list)
    n = limit * 2 if many else limit
    top = search_chunks(chunks, query, n, project)
    ent = context_entities(entities, top, project)
    return Context(top, ent, connections(ent, relations, entities), search_observations(obs, query, now, n, project), project_distribution(top) if many else None)


def project_distribution(top: DataFrame) -> DataFrame:
    return top.groupBy(none_label(F.col("project"), "(untagged)").alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project")


def bundle_rows(c: Context) -> DataFrame:
    """The bundle as one table: section, id, label, detail."""
    parts = [
        c.chunks.select(F.lit("chunk").alias("section"), "id", location(F.col("source_file"), F.col("line_start"), F.col("line_end")).alias("label"), F.col("score").cast("string").alias("detail")),
        c.entities.select(F.lit("entity").alias("section"), "id", F.col("name").alias("label"), F.col("entity_type").alias("detail")),
        c.connections.select(F.lit("connection").alias("section"), F.col("relation_id").alias("id"), F.concat_ws(" ", "direction", "other_name").alias("label"), F.col("relation_type").alias("detail")),
        c.observations.select(F.lit("observation").alias("section"), "id", F.col("obs_type").alias("label"), F.col("score").cast("string").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_rows(c: Context) -> list[dict]:
    """The entities with their connections, all of them; for reports."""
    of: dict[str, list[dict]] = {}
    for r in c.connections.orderBy("entity_id", "direction", "relation_type", "other_name", "relation_id").collect():
        of.setdefault(r["entity_id"], []).append({"direction": r["direction"], "entity": r["other_name"], "entity_type": r["other_type"], "relation": r["relation_type"], "evidence": r["evidence"]})
    fields = ["id", "name", "entity_type", "description", "project", "source_file"]
    return [{**{k: r[k] for k in fields}, "connections": of.get(r["id"], [])} for r in c.entities.select(*fields).orderBy("name", "id").collect()]


def _place(r) -> str:
    return f"{r['source_file']}:{r['line_start']}-{r['line_end']}" if r["line_start"] and r["line_end"] else f"{r['source_file']}"


def markdown(c: Context, title: str) -> str:
    """The whole bundle for reading."""
    out = [f"# Context: {title}", "", "## Chunks"]
    chunks = c.chunks.collect()
    for r in chunks:
        # a fence longer than any in the text
        fence = "`" * max(3, 1 + max(map(len, re.findall("`+", r["content"] or "")), default=0))
        out += ["", f"### {_place(r)}{' (' + r['language'] + ')' if r['language'] else ''}, similarity {r['score']:.2%}", "", f"{fence}{r['language'] or ''}", r["content"] or "", fence]
    out += [] if chunks else ["", "(no chunk matches)"]
    out += ["", "## Entities"]
    entities = entity_rows(c)
    for e in entities:
        out += ["", f"- **{e['name']}** ({e['entity_type']}){': ' + e['description'] if e['description'] else ''}"]
        out += [f"  - {x['direction']} {x['entity']} ({x['relation']})" for x in e["connections"]]
    out += [] if entities else ["", "(no entity of these files is known)"]
    if c.projects is not None:
        out += ["", "## Projects", "", *(f"- {r['project']}: {r['n']}" for r in c.projects.collect())]
    out += ["", "## Observations", ""]
    notes = [f"- [{r['obs_type']}] {r['content']} (confidence {r['confidence'] or 0:.0%}, similarity {r['score']:.2%}{', from ' + r['source'] if r['source'] else ''})" for r in c.observations.collect()]
    return "\n".join([*out, *(notes or ["(no observation matches)"])])
