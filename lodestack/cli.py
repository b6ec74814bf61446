"""Command line: ``python -m lodestack COMMAND``; ``--json`` for machines."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestack", description="Index a workspace and ask it.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *scope: str, into=sub) -> argparse.ArgumentParser:
        c = into.add_parser(name, help=text, description=text)
        c.add_argument("--json", "-j", action="store_true", help="machine-readable output")
        if "project" in scope:
            where = c.add_mutually_exclusive_group()
            where.add_argument("--project", "-p", help="one project")
            if "workspace" in scope:
                where.add_argument("--workspace", "-w", action="store_true", help="the projects beside this folder")
        return c

    add("init", "make the tables")
    add("status", "counts by table, project and type").add_argument("--diagnose", action="store_true")
    show = sub.add_parser("config", help="settings").add_subparsers(dest="what", required=True)
    add("show", "the settings in force", into=show)
    c = add("ingest", "index files", "project")
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--git-hook", action="store_true", help="only what the last commit changed")
    c.add_argument("--base", default="HEAD~1")
    c.add_argument("--prune", action="store_true", help="drop what is gone first")
    c = add("watch", "index what changes, until stopped", "project")
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--checkpoint", required=True)
    c = add("prune", "drop chunks of files that are gone", "project")
    c.add_argument("path", nargs="?", default=".")
    c.add_argument("--dry-run", action="store_true")
    ex = sub.add_parser("extract", help="chunks out, entities and relations in").add_subparsers(dest="what", required=True)
    c = add("export", "chunks by file", "project", into=ex)
    c.add_argument("--unextracted", action="store_true")
    c.add_argument("--path")
    c.add_argument("--limit", "-l", type=int, default=200)
    c.add_argument("--offset", type=int, default=0)
    c = add("import", "entities and relations from a file or stdin", "project", into=ex)
    c.add_argument("--file", "-f")
    c = add("query", "similar chunks, or observations", "project", "workspace")
    c.add_argument("text")
    c.add_argument("--recall", action="store_true")
    c.add_argument("--type", "-t")
    c.add_argument("--limit", "-l", type=int, default=10)
    add("context", "what is known about a task", "project", "workspace").add_argument("task")
    g = sub.add_parser("graph", help="entities and their edges").add_subparsers(dest="what", required=True)
    for name, text in (("show", "an entity and its edges"), ("deps", "what it depends on"), ("dependents", "what depends on it")):
        add(name, text, "project", into=g).add_argument("name")
    c = add("observe", "note something", "project")
    c.add_argument("text")
    c.add_argument("--type", "-t", default="fact")
    c.add_argument("--source", default=None)
    c.add_argument("--tags")
    c.add_argument("--confidence", type=float, default=1.0)
    add("review", "what is missing, stale or unsure", "project")
    return p


def run(w, a: argparse.Namespace, say=print) -> int:
    """Carry out one command on a workspace; the exit code."""
    from lodestack.operators import graph, review
    from lodestack.operators.context import markdown

    def out(data) -> int:
        say(json.dumps(data, default=str) if a.json else json.dumps(data, indent=2, default=str))
        return 0

    project = getattr(a, "project", None)
    scope = (w.resolve() or None) if getattr(a, "workspace", False) else project
    if a.command == "init":
        return out({"created": w.init()})
    if a.command == "config":
        return out(w.config)
    if a.command == "status":
        return out(w.diagnose() if a.diagnose else w.status())
    if a.command == "ingest" and a.git_hook:
        return out(w.ingest_commit(a.path, project, a.base))
    if a.command == "ingest":
        for event in w.ingest(a.path, project, a.prune):
            say(json.dumps(event))
        return 0
    if a.command == "watch":
        q = w.watch(a.path, a.checkpoint, project)
        try:
            q.awaitTermination()
        except KeyboardInterrupt:
            q.stop()
        return out({"events": q.activity.counts, "recent": q.activity.recent[-10:]})
    if a.command == "prune":
        return out(w.prune(a.path, project, a.dry_run))
    if a.command == "extract" and a.what == "export":
        return out(w.export(project, a.unextracted, a.path, a.limit, a.offset))
    if a.command == "extract":
        if a.file:
            return out(w.import_extraction(a.file, project))
        import tempfile

        with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # read by this machine's session only
            f.write(sys.stdin.read())
            f.flush()
            return out(w.import_extraction(f"file://{f.name}", project))
    if a.command == "query":
        return out(w.recall(a.text, a.limit, scope, a.type) if a.recall else w.query(a.text, a.limit, scope, a.type))
    if a.command == "context":
        if a.json:
            return out(w.context_data(a.task, scope))
        say(markdown(w.context(a.task, scope), a.task))
        return 0
    if a.command == "graph":
        found = w.graph(a.name, a.what != "dependents", a.what != "deps", project)
        if found is None:
            say(f"no entity {a.name}")
            return 1
        if a.json:
            return out(found)
        say(graph.text(found, graph.SHOWN_EVIDENCE if a.what == "show" else graph.LISTED_EVIDENCE))
        return 0
    if a.command == "observe":
        return out({"id": w.observe(a.text, a.type, a.source, project, a.tags, a.confidence)})
    found = w.review(project)
    if a.json:
        return out(found)
    say(review.markdown(found))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from lodestack.session import local_session, release
    from lodestack.workspace import Workspace

    spark = local_session("*")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(Workspace(spark), a)
    finally:
        release(spark)
        spark.stop()
