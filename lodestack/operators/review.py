"""The quality review: conditional counts and the findings drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import percent
from lodestack.operators.graph import orphans

LOW_CONFIDENCE, STALE_DAYS = 0.5, 90


def observation_counts(obs: DataFrame, now: Column) -> DataFrame:
    """One pass: all, decisions, warnings, of low confidence, old ones (expired ones count)."""
    return obs.agg(
        F.count("*").alias("n_obs"),
        F.count_if(F.col("obs_type") == "decision").alias("n_decisions"),
        F.count_if(F.col("obs_type") == "warning").alias("n_warnings"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("n_low"),
        F.count_if(F.col("valid_from") < now - F.expr(f"INTERVAL {STALE_DAYS} DAYS")).alias("n_stale"),
    )


def entity_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    bare = F.col("description").isNull() | (F.col("description") == "")
    base = entities.agg(F.count("*").alias("n_entities"), F.count_if(bare).alias("n_bare"))
    alone = orphans(entities, relations).agg(F.count("*").alias("n_orphans"))
    return base.join(alone, F.lit(True))  # one row each


def coverage_gaps(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Projects with chunks but no entities; never filtered by project."""
    have = chunks.where(F.col("project").isNotNull()).groupBy("project").agg(F.count("*").alias("n_chunks"))
    return have.join(entities.where(F.col("project").isNotNull()).select("project").distinct(), "project", "left_anti")


def ratio(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    a, b = entities.agg(F.count("*").alias("n_entities")), chunks.agg(F.count("*").alias("n_chunks"))
    both = a.join(b, F.lit(True))
    return both.withColumn("entity_chunk_ratio", F.when((F.col("n_entities") > 0) & (F.col("n_chunks") > 0), F.bround(F.col("n_entities") / F.col("n_chunks"), 3)))


def findings(chunks: DataFrame, entities: DataFrame, relations: DataFrame, obs: DataFrame, now: Column, every_entity: DataFrame | None = None) -> DataFrame:
    """``entities`` and ``obs`` may be those of a project; gaps are looked for among ``every_entity``.

    category, severity, n, detail: one row per rule that holds, and one per project without entities."""
    o, e = observation_counts(obs, now), entity_counts(entities, relations)
    row = o.join(e, F.lit(True))
    has_obs, has_ent = F.col("n_obs") > 0, F.col("n_entities") > 0
    alone, bare = percent(F.col("n_orphans"), F.col("n_entities")), percent(F.col("n_bare"), F.col("n_entities"))

    def rule(cond: Column, category: str, severity: Column | str, n: Column, pct: Column | None = None) -> Column:
        return F.when(cond, F.struct(F.lit(category).alias("category"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), n.cast("bigint").alias("n"), (F.lit(None).cast("double") if pct is None else pct).alias("percent"), F.lit(None).cast("string").alias("project")))

    rules = F.array_compact(
        F.array(
            rule(has_obs & (F.col("n_decisions") == 0), "no_decisions", "suggestion", F.lit(0)),
            rule(has_obs & (F.col("n_warnings") == 0), "no_warnings", "info", F.lit(0)),
            rule(F.col("n_low") > 0, "low_confidence", "suggestion", F.col("n_low")),
            rule(F.col("n_stale") > 0, "staleness", "info", F.col("n_stale")),
            rule(has_ent & (F.col("n_orphans") > 0), "orphans", F.when(alone > 30, "suggestion").otherwise("info"), F.col("n_orphans"), alone),
            rule(has_ent & (F.col("n_bare") > 0), "no_description", F.when(bare > 50, "suggestion").otherwise("info"), F.col("n_bare"), bare),
        )
    )
    gaps = coverage_gaps(chunks, entities if every_entity is None else every_entity).select(F.lit("coverage_gap").alias("category"), F.lit("suggestion").alias("severity"), F.col("n_chunks").alias("n"), F.lit(None).cast("double").alias("percent"), "project")
    return row.select(F.inline(rules)).unionByName(gaps)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "suggestion").alias("suggestions"), F.count_if(F.col("severity") == "info").alias("infos"))


_SIGNS = {"warning": "!", "suggestion": "~", "info": "-"}
_SAYS = {
    "no_decisions": "No decision is noted", "no_warnings": "No warning is noted", "low_confidence": "{n} observations are held with little confidence", "staleness": "{n} observations are older than ninety days",
    "orphans": "{n} entities have no relation ({percent:.0f} %)", "no_description": "{n} entities have no description ({percent:.0f} %)", "coverage_gap": "Project {project} has {n} chunks and no entity",
}


def markdown(data: dict) -> str:
    """A review (as ``Workspace.review`` gives it) for reading: counts, then findings by category."""
    out = ["# Review", "", f"- entities: {data['n_entities']}", f"- chunks: {data['n_chunks']}"]
    if data["entity_chunk_ratio"] is not None:
        out.append(f"- entities for each chunk: {data['entity_chunk_ratio']}")
    out += [f"- observations, {k}: {n}" for k, n in sorted(data["observations"].items())]
    for category in dict.fromkeys(f["category"] for f in data["findings"]):
        out += ["", f"## {category.replace('_', ' ').capitalize()}", ""]
        out += [f"[{_SIGNS[f['severity']]}] {_SAYS[category].format(**{**f, 'percent': f['percent'] or 0})}" for f in data["findings"] if f["category"] == category]
    return "\n".join(out if data["findings"] else [*out, "", "(nothing to mend)"])
