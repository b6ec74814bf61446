"""A workspace: a store, an embedder and a root, and every request one can make of them.

Methods return plain data, bounded by their limits; the operators below them
return frames for anything larger.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas as S
from lodestack.functions.embed import Embedder, hashing_embedder
from lodestack.operators import aggregates as A
from lodestack.operators import context as C
from lodestack.operators import graph, review, search
from lodestack.operators.ingest import Indexer
from lodestack.operators.store import Store, invalidate, patch_observations
from lodestack.session import discard, written
from lodestack.sources import config as settings
from lodestack.sources import git
from lodestack.sources.files import read_extraction

Scope = str | list[str] | None
QUERY_FIELDS = ["content", "source_file", "line_start", "line_end", "chunk_type", "language", "project", "score", "id"]


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def plain(value):
    """Rows, times and arrays as JSON has them."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, datetime):
        return value.isoformat()
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [plain(r) for r in (df if limit is None else df.limit(limit)).collect()]


class Workspace:
    def __init__(self, spark: SparkSession, config: dict | None = None, embedder: Embedder | None = None, clock: Callable[[], datetime] = utc_now, make: Callable[[], Embedder] | None = None):
        """``make`` loads the model of vectors, here for questions and in each Python worker for files; or ``embedder``
        is one. Where neither is given, words are hashed to as many dimensions as are configured."""
        self.spark, self.config, self.clock = spark, config or settings.load(), clock
        dimensions = int(self.config["embedding"]["dimensions"])
        self._make = make or ((lambda: embedder) if embedder else (lambda: partial(hashing_embedder, dimensions=dimensions)))
        self._loaded: Embedder | None = embedder
        root = self.config["store"]["root"]
        self.store = Store(spark, root if "://" in root else f"file://{os.path.abspath(root)}")

    @property
    def embedder(self) -> Embedder:
        """Loaded when first asked."""
        if self._loaded is None:
            self._loaded = self._make()
        return self._loaded

    @property
    def indexer(self) -> Indexer:
        cut = self.config["chunking"]
        return Indexer(self.spark, self.store, self._make, self.config["workspace"]["ignore"], int(cut["size"]), int(cut["overlap"]))

    # --- setup

    def init(self) -> list[str]:
        new = self.store.missing()
        self.store.create()
        return new

    def _tables(self, project: str | None = None) -> dict[str, DataFrame]:
        t = {n: self.store.read(n) for n in S.TABLES}
        return {n: df.where(F.col("project") == project) if project and "project" in df.columns else df for n, df in t.items()}

    def status(self) -> dict:
        t = self._tables()
        counts = A.status_counts(t).first().asDict()
        by = lambda c: {r[c]: r["n"] for r in A.count_by(t["chunks"], c).collect()}
        return {**counts, "files": t["chunks"].agg(F.countDistinct("source_file")).first()[0], "by_project": by("project"), "by_type": by("chunk_type")}

    def diagnose(self) -> list[dict]:
        """Checks in order; those of the tables stop at the first that fails."""
        out = [{"name": "session", "passed": self.spark.range(1).count() == 1, "detail": self.spark.version, "fix": None}]
        missing = self.store.missing()
        out.append({"name": "tables", "passed": not missing, "detail": ", ".join(missing) or "all there", "fix": "init" if missing else None})
        if not missing:
            out.append({"name": "records", "passed": True, "detail": json.dumps(A.status_counts(self._tables()).first().asDict()), "fix": None})
        try:
            size = len(self.embedder("probe"))
            out.append({"name": "embedding", "passed": True, "detail": f"{size} dimensions", "fix": None})
        except Exception as e:  # noqa: BLE001
            out.append({"name": "embedding", "passed": False, "detail": str(e), "fix": "install the model"})
        return out

    # --- indexing

    def ingest(self, root: str, project: str | None = None, prune_first: bool = False) -> Iterator[dict]:
        """Events of the work, the last with the counts."""
        self.store.create()
        if not os.path.exists(root):
            yield {"event": "error", "message": f"no such path: {root}"}
            raise FileNotFoundError(root)
        if prune_first:
            yield {"event": "prune", "status": "done", **self.indexer.prune(root, project)}
        try:
            yield from self.indexer.ingest(root, project)
        except Exception as e:
            yield {"event": "error", "message": str(e)[:500]}
            raise

    def ingest_commit(self, root: str, project: str | None = None, base: str = "HEAD~1") -> dict:
        """Re-index what the last commit changed and note the commit; nothing to index changed, nothing noted."""
        self.store.create()
        paths = [r["source_file"] for r in git.changed_paths(self.spark, root, base).collect()]
        n = self.indexer.ingest_paths(root, paths, project)
        if n["indexed"] or n["deleted"]:
            self._add_observation(git.commit_observation(git.commit_info(root), paths, project))
        return n

    def prune(self, root: str, project: str | None = None, dry_run: bool = False) -> dict:
        return self.indexer.prune(root, project, dry_run)

    def watch(self, root: str, checkpoint: str, project: str | None = None):
        from lodestack.streaming.changes import watch

        self.store.create()
        return watch(self.indexer, root, checkpoint, project)

    # --- extraction

    def export(self, project: str | None = None, unextracted: bool = False, path: str | None = None, limit: int = 200, offset: int = 0) -> dict:
        t = self._tables()
        chunks = A.unextracted(t["chunks"], t["entities"], project) if unextracted else t["chunks"]
        total = A.export_rows(chunks, project, path).count()
        page = A.export_page(chunks, limit, offset, project, path).drop("embedding").collect()
        files: dict[str, dict] = {}
        for r in page:
            f = files.setdefault(r["source_file"] or "(unknown)", {"source_file": r["source_file"], "language": r["language"] or "", "chunks": []})
            f["chunks"].append({"chunk_id": r["id"], **{k: r[k] for k in ("content", "line_start", "line_end")}})
        out = {"total": total, "offset": offset, "limit": limit, "count": len(page), "files_count": len(files), "files": list(files.values())}
        return {**out, "filter": "unextracted"} if unextracted else out

    def import_extraction(self, path: str, project: str | None = None) -> dict:
        self.store.create()
        ent, rel = read_extraction(self.spark, path)
        batch = ent.withColumn("project", F.lit(project).cast("string"))
        before = self.store.read("entities").count()
        self.store.update("entities", lambda old: graph.upsert_entities(old, batch, F.lit(self.clock()).cast("timestamp_ntz")))
        now = self.store.read("entities")
        # written, so that ids drawn and rows counted are those stored
        new = written(graph.resolve_relations(rel, now, project).withColumns({"id": F.expr("uuid()"), "metadata": F.lit(None).cast("string")}), "relations")
        n = new.count()
        self.store.append("relations", new)
        discard(new)
        return {"entities": now.count() - before, "relations": n}

    # --- questions

    def resolve(self, folder: str | None = None) -> list[str]:
        """Indexed projects among the siblings of a folder; where none match, among its children."""
        here = os.path.abspath(folder or os.getcwd())
        indexed = self.store.read("chunks").select("project")
        for base in (os.path.dirname(here), here):
            names = [n for n in sorted(os.listdir(base)) if not n.startswith(".") and os.path.isdir(os.path.join(base, n))]
            found = [r[0] for r in A.match_projects(self.spark.createDataFrame([(n,) for n in names], "name string"), indexed).collect()]
            if found:
                return found
        return []

    def query(self, text: str, limit: int = 10, project: Scope = None, chunk_type: str | None = None, threshold: float = 0.0) -> dict:
        found = search.search_chunks(self.store.read("chunks"), self.embedder(text), limit, project or None, chunk_type, threshold)
        got = rows(found.select(*QUERY_FIELDS))
        return {"query": text, "results": got, "total": len(got)}

    def recall(self, text: str, limit: int = 10, project: Scope = None, obs_type: str | None = None) -> dict:
        found = search.search_observations(self.store.read("observations"), self.embedder(text), F.lit(self.clock()).cast("timestamp_ntz"), limit, project or None, obs_type)
        got = rows(found)
        return {"query": text, "results": got, "total": len(got)}

    def context(self, task: str, project: Scope = None) -> C.Context:
        t = {n: self.store.read(n) for n in S.TABLES}
        return C.build_context(t["chunks"], t["entities"], t["relations"], t["observations"], self.embedder(task), F.lit(self.clock()).cast("timestamp_ntz"), project=project or None)

    def context_data(self, task: str, project: Scope = None) -> dict:
        c = self.context(task, project)
        out = {"query": task, "chunks": rows(c.chunks), "entities": C.entity_rows(c), "observations": rows(c.observations)}
        return {**out, "projects": rows(c.projects)} if c.projects is not None else out

    def graph(self, name: str, outgoing: bool = True, incoming: bool = True, project: str | None = None) -> dict | None:
        """An entity, of a project if one is given, and its edges, one hop; None if there is none, an error if there are several."""
        t = self._tables()
        e = graph.find_entity(t["entities"], name, project)
        if e is None:
            return None
        mine = F.col("entity_id") == e["id"]
        out = {"entity": plain(e)}
        if outgoing:
            out["outgoing"] = rows(graph.outgoing(t["relations"], t["entities"]).where(mine))
        if incoming:
            out["incoming"] = rows(graph.incoming(t["relations"], t["entities"]).where(mine))
        return out

    # --- observations

    def _add_observation(self, o: dict) -> str:
        o = {"id": str(uuid.uuid4()), "embedding": self.embedder(o["content"]), "valid_from": self.clock(), "valid_until": None, "metadata": None, **o}
        new = self.spark.createDataFrame([tuple(o[f.name] for f in S.OBSERVATIONS)], S.OBSERVATIONS)
        self.store.append("observations", new)
        return o["id"]

    def observe(self, content: str, obs_type: str = "fact", source: str | None = None, project: str | None = None, tags: str | None = None, confidence: float = 1.0) -> str:
        self.store.create()
        parts = [t.strip() for t in tags.split(",")] if tags else None
        return self._add_observation({"content": content, "obs_type": obs_type, "source": source, "project": project, "tags": parts, "confidence": confidence})

    def list_observations(self, limit: int = 50, offset: int = 0, project: str | None = None, obs_type: str | None = None) -> list[dict]:
        """Newest first, expired ones too."""
        return rows(search.list_observations(self.store.read("observations"), limit, offset, project, obs_type).drop("embedding"))

    def _observation(self, key: str) -> dict | None:
        found = rows(self.store.read("observations").where(F.col("id") == key).drop("embedding"), 1)
        return found[0] if found else None

    def update_observation(self, key: str, content: str | None = None, obs_type: str | None = None, project: str | None = None, confidence: float | None = None) -> dict | None:
        """The observation after the change of what is given, None if there is none; a new content gets its vector."""
        if self._observation(key) is None:
            return None
        patch = self.spark.createDataFrame([(key, content, obs_type, project, confidence)], "id string, content string, obs_type string, project string, confidence double")
        vector = F.lit(self.embedder(content)).cast("array<float>") if content is not None else F.col("embedding")
        mine = F.when(F.col("id") == key, vector).otherwise(F.col("embedding"))
        self.store.update("observations", lambda old: patch_observations(old, patch).withColumn("embedding", mine))
        return self._observation(key)

    def invalidate_observation(self, key: str) -> dict | None:
        """The observation, which ends now; None if there is none."""
        if self._observation(key) is None:
            return None
        gone = self.spark.createDataFrame([(key,)], "id string")
        self.store.update("observations", lambda old: invalidate(old, gone, F.lit(self.clock()).cast("timestamp_ntz")))
        return self._observation(key)

    def review(self, project: str | None = None) -> dict:
        t = self._tables(project)
        everything = self._tables()
        found = review.findings(everything["chunks"], t["entities"], everything["relations"], t["observations"], F.lit(self.clock()).cast("timestamp_ntz"), everything["entities"])
        data = found.collect()  # a row per rule and per project without entities
        return {
            "summary": {s: sum(r["severity"] == s for r in data) for s in ("warning", "suggestion", "info")}, "findings": [plain(r) for r in data],
            "observations": {r["obs_type"]: r["n"] for r in A.count_by(t["observations"], "obs_type").collect()}, **review.ratio(t["chunks"], t["entities"]).first().asDict(),
        }
