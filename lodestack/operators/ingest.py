"""From files on disk to chunks in a store."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.embed import Embedder, embed
from lodestack.operators.chunking import OVERLAP, SIZE, chunk_files
from lodestack.operators.store import Store, delete_files, mark_stale, replace_files, stale_files
from lodestack.session import discard, written
from lodestack.sources.files import gather_rules, read_files, wanted


def as_chunks(chunked: DataFrame, project: str | None, root: str) -> DataFrame:
    """Rows of the chunk table without vectors; the id is a hash of place and content, so a re-run gives the same."""
    p = F.lit(project).cast("string")
    key = F.concat_ws("\x01", F.coalesce(p, F.lit("\x02")), "source_file", F.coalesce(F.col("line_start").cast("string"), F.lit("")), "checksum")
    return chunked.select(
        F.sha2(key, 256).alias("id"), "content", "source_file", "line_start", "line_end", "chunk_type", "language", p.alias("project"), "checksum",
        F.localtimestamp().alias("indexed_at"), F.to_json(F.struct(F.lit(os.path.abspath(root)).alias("root"))).alias("metadata"),
    )


@dataclass
class Indexer:
    """How a workspace cuts, embeds and filters files; ``make`` loads the model of its vectors."""

    spark: SparkSession
    store: Store
    make: Callable[[], Embedder] | None = None
    rules: list[str] | None = None
    size: int = SIZE
    overlap: int = OVERLAP

    def rules_of(self, root: str) -> list[str]:
        return gather_rules(root, self.rules) if os.path.isdir(root) else list(self.rules or [])

    def chunks(self, files: DataFrame, project: str | None, root: str) -> DataFrame:
        return as_chunks(chunk_files(files, self.size, self.overlap), project, root)

    def stored(self, walked: DataFrame, new: DataFrame) -> None:
        """The walked files' chunks replaced by new ones; vectors are computed once, also where another writer was first."""
        vectors = written(embed(new, make=self.make), "embedded")
        self.store.update("chunks", lambda old: replace_files(old, walked, vectors))
        discard(vectors)

    def ingest(self, root: str, project: str | None = None) -> Iterator[dict]:
        """Index a folder, as events: every walked file's chunks are replaced in one new snapshot."""
        yield {"event": "chunking", "status": "start", "path": root}
        files = read_files(self.spark, root, self.rules_of(root))
        new = written(self.chunks(files, project, root), "chunks")
        n = new.agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("files")).first().asDict()
        yield {"event": "chunking", "status": "done", **n}
        yield {"event": "embedding", "status": "start", "total": n["chunks"]}
        vectors = written(embed(new, make=self.make), "embedded")
        yield {"event": "embedding", "status": "progress", "done": n["chunks"], "total": n["chunks"]}
        yield {"event": "storing", "status": "start"}
        # a file that has become empty loses its chunks
        walked = files.select(F.lit(project).cast("string").alias("project"), "source_file")
        self.store.update("chunks", lambda old: replace_files(old, walked, vectors))
        discard(new)
        discard(vectors)
        yield {"event": "complete", **n}

    def ingest_paths(self, root: str, paths: list[str], project: str | None = None) -> dict[str, int]:
        """Re-index some files of a root, and open no others. Those that are gone lose their chunks; ignored
        ones and those of other kinds are passed over."""
        paths = wanted(sorted(set(paths)), self.rules_of(root))
        if not paths:
            return {"indexed": 0, "deleted": 0}
        touched = self.spark.createDataFrame([(project, p) for p in paths], "project string, source_file string")
        there = [p for p in paths if os.path.isfile(os.path.join(root, p))]
        if there:
            self.stored(touched, self.chunks(read_files(self.spark, root, [], there), project, root))
        else:
            self.store.update("chunks", lambda old: delete_files(old, touched))
        return {"indexed": len(there), "deleted": len(paths) - len(there)}

    def prune(self, root: str, project: str | None = None, dry_run: bool = False) -> dict:
        """Drop chunks of files that are no longer there and mark their entities; only of the project.
        The names are collected for the report alone."""
        chunks = self.store.read("chunks")
        mine = chunks.where(F.col("project").eqNullSafe(F.lit(project)))
        disk = read_files(self.spark, root, self.rules_of(root)).select(F.lit(project).cast("string").alias("project"), "source_file")
        gone = written(stale_files(mine, disk), "gone")
        names = sorted(r["source_file"] for r in gone.collect())
        out = {"stale_files": names, "chunks_deleted": 0, "entities_marked_stale": 0}
        if dry_run:
            return {**out, "dry_run": True} if names else out
        if names:
            out["chunks_deleted"] = mine.join(gone.select("source_file"), "source_file", "left_semi").count()
            out["entities_marked_stale"] = self.store.read("entities").join(gone.select("source_file").distinct(), "source_file", "left_semi").count()
            self.store.update("chunks", lambda old: delete_files(old, gone))
            self.store.update("entities", lambda old: mark_stale(old, gone))
        discard(gone)
        return out
