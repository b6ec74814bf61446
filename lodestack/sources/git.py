"""What a commit changed, and the commit itself."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession

TIMEOUT_S = 30


def _git(root: str, *args: str) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=TIMEOUT_S)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.strip() if done.returncode == 0 else ""


def changed_paths(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    """Paths that differ from ``base``; where nothing does, those staged."""
    out = _git(root, "diff", "--name-only", base, "HEAD") or _git(root, "diff", "--name-only", "--cached")
    return spark.createDataFrame([(p,) for p in out.splitlines() if p], "source_file string")


def commit_info(root: str) -> dict[str, str]:
    parts = _git(root, "log", "-1", "--format=%H%x00%an <%ae>%x00%s%x00%aI").split("\0")
    keys = ("hash", "author", "message", "date")
    return dict(zip(keys, parts)) if len(parts) == 4 else dict.fromkeys(keys, "unknown")


def commit_observation(info: dict[str, str], files: list[str], project: str | None) -> dict:
    return {
        "content": f"Commit {info['hash'][:8]}: {info['message']} ({len(files)} files) by {info['author']}", "obs_type": "fact", "source": "git", "project": project,
        "tags": ["commit", "git"], "confidence": 1.0, "metadata": json.dumps({**info, "changed_files": files}),
    }
