"""The logical tables of the test data, in Spark and in SQL: one row per record, ids in one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.current import current
from lodestack.operators.references import canonical_id
from lodestack.session import table

ACTIVE_NOW, REVIEW_NOW = "2025-12-01 00:00:00", "2026-06-01 00:00:00"


def stamp(text: str):
    return F.lit(text).cast("timestamp_ntz")


class Tables:
    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)

    @property
    def chunks(self) -> DataFrame:
        return current(self.raw("chunks"), "indexed_at")

    @property
    def entities(self) -> DataFrame:
        return current(self.raw("entities").withColumn("id", canonical_id(F.col("id"))), "updated_at")

    @property
    def relations(self) -> DataFrame:
        return current(self.raw("relations").withColumns({c: canonical_id(F.col(c)) for c in ("source_id", "target_id")}))

    @property
    def edges(self) -> DataFrame:
        """Relations with their copies, where these make no difference."""
        return self.raw("relations").withColumns({c: canonical_id(F.col(c)) for c in ("source_id", "target_id")})

    @property
    def observations(self) -> DataFrame:
        return current(self.raw("observations"))

    def entities_in(self, few: DataFrame, column: str) -> DataFrame:
        """Entities whose ``column`` is among a few rows; as it is alike in all copies of one, those are cut down first."""
        rows = self.raw("entities").withColumn("id", canonical_id(F.col("id")))
        return current(rows.join(F.broadcast(few), column, "left_semi"), "updated_at")

    def relations_of(self, few: DataFrame) -> DataFrame:
        """Relations that touch one of a few entities (``id``)."""
        both = self.edges
        ends = F.broadcast(few.select("id").distinct())
        mine = both.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(both.join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi"))
        return current(mine)

    def query_vector(self, vec_id: int = 0) -> list[float]:
        return self.query_vectors([vec_id])[vec_id]

    def query_vectors(self, ids: list[int]) -> dict[int, list[float]]:
        rows = self.raw("embeddings").where(F.col("vec_id").isin(ids)).select("vec_id", "embedding").collect()
        return {r[0]: [float(x) for x in r[1]] for r in rows}


def canon_sql(c: str) -> str:
    bare = f"lower(regexp_replace({c}, '[\\s{{}}\\-]', '', 'g'))"
    dashed = f"regexp_replace({bare}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9a-f]{{32}}$') THEN {dashed} ELSE {c} END"


_CTE = {
    "c": "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)",
    "e": f"e AS (SELECT * EXCLUDE (rn) FROM (SELECT * REPLACE ({canon_sql('id')} AS id), row_number() OVER (PARTITION BY {canon_sql('id')} ORDER BY updated_at DESC NULLS LAST) AS rn FROM entities) WHERE rn = 1)",
    "r": f"r AS (SELECT * EXCLUDE (rn) FROM (SELECT * REPLACE ({canon_sql('source_id')} AS source_id, {canon_sql('target_id')} AS target_id), row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM relations) WHERE rn = 1)",
    "o": "o AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM observations) WHERE rn = 1)",
}


def sql(tables: str, body: str, *more: str) -> str:
    """A statement over the bindings named by letter; ``more`` are further CTEs."""
    return "WITH " + ", ".join([*(_CTE[t] for t in tables), *more]) + " " + body


