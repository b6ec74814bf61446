"""Orphan references: records that point to records which aren't there.

A reference is (table, field, record, key, time). Its key is looked up among
the targets of its kind; what comes out is one row per distinct record, field
and key whose target is missing, deleted or came only later.

Scale: references are combined to one row each, written once, and counted per key and period.
The ``HEAVY_KEYS`` most used keys, a fixed number, are resolved apart: their state
is a table of at most that many rows, broadcast to their references, so that a
key which holds a third of all references never meets in one task. The other
keys go through shuffle joins, which AQE may split further. Both parts are
united. Targets are combined to one row per key before they are shuffled.
Counts of orphans come from the keys' periods alone: a period with its number of
references and their first and last time tells how many are deleted, missing or late;
only of periods in which the target came are the references themselves compared.

Cases: null keys and empty paths are no references; a key that is no UUID is
compared as written; a reference without a readable time has the month
``unknown`` and is never late; several copies of a record count as one, with
its earliest time; empty tables give an empty result; extra columns are never
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.columns import pick
from lodestack.session import written

HEAVY_KEYS = 256
DAY_US = 86_400_000_000
UUID_BARE = "^[0-9a-f]{32}$"
#: Parts of a file key; a path holds no control characters.
SEP = "\x01"
NO_PROJECT = "\x02"


def canonical_id(c: Column) -> Column:
    """UUIDs in lower case with hyphens, whatever their spelling; else as written."""
    bare = F.lower(F.regexp_replace(c, r"[\s{}\-]", ""))
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike(UUID_BARE), dashed).otherwise(c)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less UTC timestamp, whatever the session's zone."""
    since = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), since)
    return part("DAY").cast("bigint") * DAY_US + part("HOUR").cast("bigint") * 3_600_000_000 + part("MINUTE").cast("bigint") * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def iso_micros(text: Column) -> Column:
    """The same of ISO 8601 text, with or without offset; null if unreadable."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d:\d"), t).otherwise(F.concat(t, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.unix_micros(zoned.try_cast("timestamp"))


def month_of(us: Column) -> Column:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY_US).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def file_key(project: Column, path: Column) -> Column:
    return F.concat(F.coalesce(project, F.lit(NO_PROJECT)), F.lit(SEP), path)


def references(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """ref_table, ref_field, record_id, ref_key, kind, key, ref_us; one row per record, field and key."""
    rel = pick(relations, "id", "source_id", "target_id", "metadata").select(
        canonical_id(F.col("id")).alias("record_id"),
        "source_id",
        "target_id",
        iso_micros(F.get_json_object("metadata", "$.extracted_at")).alias("ref_us"),
    )
    ends = rel.select(
        F.lit("relations").alias("ref_table"),
        "record_id",
        "ref_us",
        F.inline(
            F.array(
                F.struct(F.lit("source_id").alias("ref_field"), F.col("source_id").alias("raw")),
                F.struct(F.lit("target_id").alias("ref_field"), F.col("target_id").alias("raw")),
            )
        ),
    ).select(
        "ref_table", "ref_field", "record_id", canonical_id(F.col("raw")).alias("ref_key"),
        F.lit("entity").alias("kind"), canonical_id(F.col("raw")).alias("key"), "ref_us",
    )
    ent = pick(entities, "id", "project", "source_file", "properties", "updated_at").select(
        F.lit("entities").alias("ref_table"),
        canonical_id(F.col("id")).alias("record_id"),
        "project",
        "source_file",
        F.col("properties.chunk_ids").alias("chunk_ids"),
        micros(F.col("updated_at")).alias("ref_us"),
    )
    chunks = ent.select(
        "ref_table", F.lit("chunk_ids").alias("ref_field"), "record_id", "ref_us", F.explode("chunk_ids").alias("raw")
    ).select(
        "ref_table", "ref_field", "record_id", canonical_id(F.col("raw")).alias("ref_key"),
        F.lit("chunk").alias("kind"), canonical_id(F.col("raw")).alias("key"), "ref_us",
    )
    files = ent.where(F.col("source_file") != "").select(
        "ref_table", F.lit("source_file").alias("ref_field"), "record_id", F.col("source_file").alias("ref_key"),
        F.lit("file").alias("kind"), file_key(F.col("project"), F.col("source_file")).alias("key"), "ref_us",
    )
    return (
        ends.unionByName(chunks)
        .unionByName(files)
        .where(F.col("key").isNotNull() & F.col("record_id").isNotNull())
        .groupBy("ref_table", "ref_field", "record_id", "ref_key", "kind", "key")
        .agg(F.min("ref_us").alias("ref_us"))
    )


def targets(entities: DataFrame, chunks: DataFrame, removals: DataFrame, file_events: DataFrame) -> DataFrame:
    """kind, key, there_us, there, removed: one row per key that exists or was removed."""
    ent = pick(entities, "id", "created_at").select(
        F.lit("entity").alias("kind"), canonical_id(F.col("id")).alias("key"), micros(F.col("created_at")).alias("us")
    )
    seen = pick(chunks, "id", "project", "source_file", "indexed_at").select("id", "project", "source_file", micros(F.col("indexed_at")).alias("us"))
    chk = seen.select(F.lit("chunk").alias("kind"), canonical_id(F.col("id")).alias("key"), "us")
    fil = seen.where(F.col("source_file").isNotNull()).select(
        F.lit("file").alias("kind"), file_key(F.col("project"), F.col("source_file")).alias("key"), "us"
    )
    there = ent.unionByName(chk).unionByName(fil).select("kind", "key", "us", F.lit(True).alias("there"))
    gone = pick(removals, "record_table", "record_id").select(
        F.when(F.lower(F.trim("record_table")) == "entities", "entity").otherwise("chunk").alias("kind"),
        canonical_id(F.col("record_id")).alias("key"),
    )
    # an event's path is project/path or the bare path: both readings are kept
    deleted = pick(file_events, "path", "action").where(F.lower(F.trim("action")) == "delete").select("path").where("path is not null")
    split = F.instr("path", "/")
    named = deleted.where(split > 1).select(
        F.lit("file").alias("kind"),
        file_key(F.expr("substring(path, 1, instr(path, '/') - 1)"), F.expr("substring(path, instr(path, '/') + 1)")).alias("key"),
    )
    bare = deleted.select(F.lit("file").alias("kind"), file_key(F.lit(None).cast("string"), F.col("path")).alias("key"))
    removed = gone.unionByName(named).unionByName(bare).select(
        "kind", "key", F.lit(None).cast("bigint").alias("us"), F.lit(False).alias("there")
    )
    return (
        there.unionByName(removed)
        .where(F.col("key").isNotNull())
        .groupBy("kind", "key")
        .agg(
            F.min("us").alias("there_us"),
            F.max("there").alias("there"),
            F.max(~F.col("there")).alias("removed"),
        )
    )


FIELDS = ["ref_table", "ref_field", "kind", "key"]


def key_periods(refs: DataFrame) -> DataFrame:
    """How often each key is referred to in each month, by field, and the first and last time."""
    return refs.groupBy(*FIELDS, month_of(F.col("ref_us")).alias("ref_month")).agg(F.count("*").alias("n"), F.min("ref_us").alias("first_us"), F.max("ref_us").alias("last_us"))


def heavy_keys(periods: DataFrame, most: int = HEAVY_KEYS) -> DataFrame:
    """The ``most`` most used keys (kind, key): a number of rows that doesn't grow with the data."""
    return periods.groupBy("kind", "key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "kind", "key").limit(most).select("kind", "key")


def _with_targets(rows: DataFrame, heavy: DataFrame, goals: DataFrame) -> DataFrame:
    """``rows`` with the state of their key's target: heavy keys by broadcast, the others by shuffle."""
    heavy = F.broadcast(heavy)
    # at most as many rows as there are heavy keys, whatever the size of the tables
    hot = rows.join(F.broadcast(heavy.join(goals, ["kind", "key"], "left")), ["kind", "key"])
    rest = rows.join(heavy, ["kind", "key"], "left_anti").join(goals, ["kind", "key"], "left")
    return hot.unionByName(rest.select(*hot.columns)).withColumns({"there": F.coalesce("there", F.lit(False)), "removed": F.coalesce("removed", F.lit(False))})


class References:
    """All references of a workspace, combined and written once."""

    def __init__(self, relations: DataFrame, entities: DataFrame, chunks: DataFrame, removals: DataFrame, file_events: DataFrame, most_heavy: int = HEAVY_KEYS):
        self.refs = written(references(relations, entities), "references")
        self.periods = key_periods(self.refs)
        self.heavy = written(heavy_keys(self.periods, most_heavy), "heavy-keys")
        self.goals = targets(entities, chunks, removals, file_events)

    def orphans(self) -> DataFrame:
        """One row per distinct record, field and key whose target is missing, deleted or late."""
        rows = _with_targets(self.refs, self.heavy, self.goals)
        late = F.col("there") & (F.col("there_us") > F.col("ref_us"))
        state = F.when(~F.col("there"), F.when(F.col("removed"), "deleted").otherwise("missing")).when(late, "late")
        # a file's key holds its project too, which the result doesn't
        return (
            rows.withColumn("ref_state", state).where(F.col("ref_state").isNotNull())
            .select("ref_table", "ref_field", "record_id", "ref_key", "ref_state", month_of(F.col("ref_us")).alias("ref_month")).distinct()
        )

    def counts(self) -> DataFrame:
        """Orphans per table, field, month and state, from the keys' periods."""
        rows = _with_targets(self.periods, self.heavy, self.goals)
        clear = F.when(~F.col("there"), F.when(F.col("removed"), "deleted").otherwise("missing")).when(F.col("there_us") > F.col("last_us"), "late")
        out = ["ref_table", "ref_field", "ref_month", "ref_state", "n"]
        told = rows.withColumn("ref_state", clear).where(F.col("ref_state").isNotNull()).select(*out)
        # the target came within the period: its references are looked at one by one
        within = rows.where(F.col("there") & (F.col("there_us") > F.col("first_us")) & (F.col("there_us") <= F.col("last_us"))).select(*FIELDS, "ref_month", "there_us")
        late = (
            self.refs.withColumn("ref_month", month_of(F.col("ref_us"))).join(within, [*FIELDS, "ref_month"]).where(F.col("there_us") > F.col("ref_us"))
            .groupBy("ref_table", "ref_field", "ref_month").agg(F.count("*").alias("n")).withColumn("ref_state", F.lit("late")).select(*out)
        )
        return told.unionByName(late).groupBy(*out[:-1]).agg(F.sum("n").alias("n_references"))


def orphan_references(relations: DataFrame, entities: DataFrame, chunks: DataFrame, removals: DataFrame, file_events: DataFrame, most_heavy: int = HEAVY_KEYS) -> DataFrame:
    """One row per distinct record, field and key whose target is missing, deleted or late."""
    return References(relations, entities, chunks, removals, file_events, most_heavy).orphans()


def orphan_counts(relations: DataFrame, entities: DataFrame, chunks: DataFrame, removals: DataFrame, file_events: DataFrame, most_heavy: int = HEAVY_KEYS) -> DataFrame:
    """Orphans per table, field, month and state."""
    return References(relations, entities, chunks, removals, file_events, most_heavy).counts()
