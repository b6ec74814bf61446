"""Change feeds: a source that compares snapshots of a folder, debounce, and the
handler that keeps the chunks of a store in step.

A file stream tracks paths, not versions, and never reports deletes; so the
source lists the folder and emits what differs. Listings are kept as files in
the watch's checkpoint; an offset is the number of one, however many files there are. What
a walk would not index (ignored paths, other kinds of files) makes no event.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lodestack.sources.files import gather_rules, wanted

EVENT = "path string, action string, ts timestamp, seq bigint"


def listing(root: str, rules: list[str] | None = None) -> dict[str, list[int]]:
    """Time and size of each file that is to be indexed."""
    all_rules, out = gather_rules(root, rules), {}
    for folder, dirs, names in os.walk(root):
        here = os.path.relpath(folder, root)
        dirs[:] = [d for d in dirs if d != ".git"]
        for p in wanted([os.path.normpath(os.path.join(here, n)) for n in names], all_rules):
            try:
                s = os.stat(os.path.join(root, p))
            except OSError:
                continue
            out[p] = [s.st_mtime_ns, s.st_size]
    return out


def difference(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str]]:
    """A move is a delete and a create."""
    gone = [(p, "delete") for p in sorted(old.keys() - new.keys())]
    return gone + [(p, "modify" if p in old else "create") for p in sorted(new) if old.get(p) != new[p]]


class _Reader(SimpleDataSourceStreamReader):
    """Runs on the driver; ``state`` is a folder of the checkpoint."""

    def __init__(self, root: str, state: str, rules: list[str]):
        self.root, self.state, self.rules = root, state, rules

    def _file(self, n: int) -> str:
        return os.path.join(self.state, f"{n}.json")

    def _load(self, n: int) -> dict[str, list[int]]:
        if not n:
            return {}
        with open(self._file(n), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = int(start["listing"])
        new = listing(self.root, self.rules)
        if not difference(self._load(n), new):
            return iter([]), start
        os.makedirs(self.state, exist_ok=True)
        fresh = f"{self._file(n + 1)}.new"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(new, f)
        os.replace(fresh, self._file(n + 1))
        end = {"listing": n + 1}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        a, b = int(start["listing"]), int(end["listing"])
        found, now = difference(self._load(a), self._load(b)), datetime.now(timezone.utc).replace(tzinfo=None)
        return iter([(p, action, now, (b << 32) + i) for i, (p, action) in enumerate(found)])

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state) if os.path.isdir(self.state) else []:
            if name.endswith(".json") and int(name[:-5]) < int(end["listing"]):
                os.remove(os.path.join(self.state, name))


class FolderChanges(DataSource):
    """``spark.dataSource.register(FolderChanges)``, then ``readStream.format("folder_changes")`` with the
    options ``state`` (a folder to keep listings in) and ``rules`` (JSON), ``.load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return EVENT

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options["state"], json.loads(self.options.get("rules", "[]")))


def debounced(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The last action of each burst of a path; a burst ends when nothing follows within ``gap``.

    Works on a batch, and on a stream with a watermark."""
    return events.groupBy("path", F.session_window("ts", gap).alias("w")).agg(
        F.max_by(F.lower("action"), F.struct("ts", "seq")).alias("action"), F.max("ts").alias("ts"), F.count("*").alias("n_events")
    ).select("path", "action", "ts", "n_events")


def last_actions(events: DataFrame) -> DataFrame:
    """The state of each path after all its events: what remains to be done for it."""
    return events.groupBy("path").agg(F.max_by(F.lower("action"), F.struct("ts", "seq")).alias("action"), F.count("*").alias("n_events"))


def apply_changes(chunks: DataFrame, actions: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Chunks after the last actions: every touched file's go, those of ``new`` come. A path is project/source_file or the bare path."""
    path = F.concat_ws("/", "project", "source_file")
    left = chunks.withColumn("_p", path).join(actions.select(F.col("path").alias("_p")).distinct(), "_p", "left_anti").drop("_p")
    return left if new is None else left.unionByName(new)


class Activity:
    """Running counts and the last twenty events of a watch."""

    def __init__(self, most: int = 20):
        self.counts: dict[str, int] = {}
        self.recent: list[tuple[str, str]] = []
        self.most = most

    def add(self, path: str, action: str) -> None:
        self.counts[action] = self.counts.get(action, 0) + 1
        self.recent = [*self.recent, (path, action)][-self.most :]


def watch(indexer, root: str, checkpoint: str, project: str | None = None, interval: str = "500 milliseconds"):
    """A streaming query that re-indexes what changes under ``root`` in the indexer's store.

    A batch is the unit of debounce: of each path the last action counts. It is
    idempotent, as it replaces whole files by what is on disk now."""
    spark = indexer.spark
    spark.dataSource.register(FolderChanges)
    seen = Activity()
    # the driver lists what is mounted to it, and keeps the listings there too
    local = checkpoint.removeprefix("file://")
    if "://" in local:
        raise ValueError(f"a watch needs a checkpoint that is mounted to the driver, not {checkpoint}")

    def handle(batch: DataFrame, _: int) -> None:
        rows = last_actions(batch).select("path", "action").collect()  # paths of one interval
        if rows:
            indexer.ingest_paths(root, [r["path"] for r in rows], project)
            for r in rows:
                seen.add(r["path"], r["action"])

    source = spark.readStream.format("folder_changes").option("state", os.path.join(local, "listings")).option("rules", json.dumps(indexer.rules or []))
    q = source.load(root).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    q = q.trigger(processingTime=interval).start()
    q.activity = seen
    return q


__all__ = ["FolderChanges", "Activity", "apply_changes", "debounced", "difference", "last_actions", "listing", "watch"]
