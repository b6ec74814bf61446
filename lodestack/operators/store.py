"""Tables as versioned snapshots, and changes as new snapshots.

Parquet has no update; a change is a frame that joins the old snapshot with
what changes it (anti-joins and unions, so a change of a million files is one
pass), written beside it. A version is a small numbered file that lists the
folders of its rows; it is written whole under another name and then renamed to its
number, which fails if another writer was first. A change is made anew on that
one's version then, so no writer's change is lost, and a reader always finds a
whole version: it holds the one it started with, and nothing is overwritten.
New rows alone (``append``) add a folder and rewrite nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.schemas import TABLES

ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other writers were first again and again."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        at = self._path(f"{self.root}/{table}/_versions")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def _folders(self, table: str, number: int) -> list[str]:
        stream = self._fs.open(self._path(f"{self.root}/{table}/_versions/{number:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self, table: str) -> int | None:
        numbers = self._versions(table)
        return numbers[-1] if numbers else None

    def _claim(self, table: str, number: int, folders: list[str]) -> bool:
        """Make a version of this number, unless there is one."""
        target = self._path(f"{self.root}/{table}/_versions/{number:012d}")
        fresh = self._path(f"{self.root}/{table}/_versions/new-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(folders), "utf-8"))
        out.close()
        done = not self._fs.exists(target) and self._fs.rename(fresh, target)
        if not done:
            self._fs.delete(fresh, False)
        return done

    def create(self) -> None:
        """Make the tables that aren't there; twice is once."""
        for name, schema in TABLES.items():
            if self.version(name) is None:
                self._claim(name, 1, [self._put(name, self.spark.createDataFrame([], schema))])

    def _at(self, table: str, number: int) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(*(f"{self.root}/{table}/{f}" for f in self._folders(table, number)))

    def read(self, table: str) -> DataFrame:
        number = self.version(table)
        if number is None:
            raise LookupError(f"no table {table} in {self.root}")
        return self._at(table, number)

    def _put(self, table: str, df: DataFrame) -> str:
        folder = f"v-{uuid.uuid4().hex}"
        df.select(*(f.name for f in TABLES[table])).write.parquet(f"{self.root}/{table}/{folder}")
        return folder

    def update(self, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """The version after ``change``, which gets the table as it is; it may be called again."""
        for _ in range(ATTEMPTS):
            number = self.version(table)
            if number is None:
                raise LookupError(f"no table {table} in {self.root}")
            if self._claim(table, number + 1, [self._put(table, change(self._at(table, number)))]):
                return number + 1
        raise Conflict(table)

    def write(self, table: str, df: DataFrame) -> int:
        """All rows replaced by those of ``df``, whatever they are now."""
        folder = self._put(table, df)
        for _ in range(ATTEMPTS):
            if self._claim(table, number := (self.version(table) or 0) + 1, [folder]):
                return number
        raise Conflict(table)

    def append(self, table: str, df: DataFrame) -> int:
        """Rows added, none rewritten."""
        folder = self._put(table, df)
        for _ in range(ATTEMPTS):
            number = self.version(table)
            if number is None:
                raise LookupError(f"no table {table} in {self.root}")
            if self._claim(table, number + 1, [*self._folders(table, number), folder]):
                return number + 1
        raise Conflict(table)

    def missing(self) -> list[str]:
        return [t for t in TABLES if self.version(t) is None]


def _file_key(df: DataFrame, scope: str) -> list[str]:
    return ["source_file"] if scope == "file" else ["project", "source_file"]


def delete_files(chunks: DataFrame, files: DataFrame, scope: str = "project") -> DataFrame:
    """Chunks of other files. A file is (project, source_file), null projects equal;
    ``scope="file"`` goes by the path alone."""
    keys = files.select(*(F.col(k).alias(f"d_{k}") for k in _file_key(chunks, scope))).distinct()
    cond = F.col("source_file") == F.col("d_source_file")
    if scope != "file":
        cond = cond & F.col("project").eqNullSafe(F.col("d_project"))
    return chunks.join(keys, cond, "left_anti")


def replace_files(chunks: DataFrame, walked: DataFrame, new: DataFrame, scope: str = "project") -> DataFrame:
    """Every walked file's chunks replaced by the new ones, also where there are none now."""
    return delete_files(chunks, walked, scope).unionByName(new)


def changed_only(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks whose checksum their file doesn't hold yet."""
    old = stored.select(F.col("project").alias("o_project"), F.col("source_file").alias("o_file"), F.col("checksum").alias("o_sum")).distinct()
    return new.join(old, new.project.eqNullSafe(F.col("o_project")) & (new.source_file == F.col("o_file")) & (new.checksum == F.col("o_sum")), "left_anti")


def mark_stale(entities: DataFrame, files: DataFrame) -> DataFrame:
    """properties.stale set for entities of the files (source_file); others as they are."""
    gone = files.where(F.col("source_file").isNotNull()).select(F.col("source_file").alias("_gone")).distinct()
    joined = entities.join(gone, entities.source_file == F.col("_gone"), "left")
    props = F.struct(F.col("properties.chunk_ids").alias("chunk_ids"), F.lit(True).alias("stale"))
    return joined.withColumn("properties", F.when(F.col("_gone").isNotNull(), props).otherwise(F.col("properties"))).drop("_gone")


def stale_files(chunks: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Indexed files that aren't on disk."""
    disk = on_disk.select(F.col("project").alias("k_project"), F.col("source_file").alias("k_file")).distinct()
    indexed = chunks.where(F.col("source_file").isNotNull()).select("project", "source_file").distinct()
    return indexed.join(disk, indexed.project.eqNullSafe(F.col("k_project")) & (indexed.source_file == F.col("k_file")), "left_anti")


def patch_observations(obs: DataFrame, patches: DataFrame) -> DataFrame:
    """Values of ``patches`` (id and any of content, obs_type, project, confidence) where
    they aren't null; a changed content loses its vector, to be embedded again."""
    fields = [c for c in ("content", "obs_type", "project", "confidence") if c in patches.columns]
    p = patches.select("id", *(F.col(c).alias(f"p_{c}") for c in fields))
    j = obs.join(p, "id", "left")
    changed = F.col("p_content").isNotNull() & (F.col("p_content") != F.col("content")) if "content" in fields else F.lit(False)
    j = j.withColumn("embedding", F.when(changed, F.lit(None)).otherwise(F.col("embedding")))
    return j.withColumns({c: F.coalesce(f"p_{c}", c) for c in fields}).drop(*(f"p_{c}" for c in fields))


def invalidate(obs: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """valid_until set to now for the ids; unknown ids change nothing."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    return obs.join(gone, obs.id == F.col("_id"), "left").withColumn("valid_until", F.when(F.col("_id").isNotNull(), now).otherwise(F.col("valid_until"))).drop("_id")
