import json
import subprocess
from datetime import datetime

import pytest

from lodestack.cli import parser, run
from lodestack.operators.graph import AmbiguousEntity
from lodestack.sources import config
from lodestack.workspace import Workspace


@pytest.fixture
def w(spark, tmp_path):
    c = config.load(None, {})
    c["store"]["root"] = str(tmp_path / "store")
    return Workspace(spark, c, clock=lambda: datetime(2025, 6, 1))


def call(w, *argv):
    said = []
    code = run(w, parser().parse_args([*argv, "--json"]), said.append)
    return code, [json.loads(x) if x[:1] in "[{" else x for x in said]


def test_a_day_of_a_workspace(w, tmp_path, monkeypatch):
    root = tmp_path / "Proj-One"
    root.mkdir()
    (root / "a.py").write_text("def load(path):\n    return open(path)\n")
    (root / "b.md").write_text("# Loading\n\nHow a path is loaded, in words.\n")
    assert sorted(call(w, "init")[1][0]["created"]) == ["chunks", "entities", "observations", "relations"] and call(w, "init")[1][0]["created"] == []
    events = call(w, "ingest", str(root), "-p", "projone")[1]
    assert events == [
        {"event": "chunking", "status": "start", "path": str(root)}, {"event": "chunking", "status": "done", "chunks": 2, "files": 2}, {"event": "embedding", "status": "start", "total": 2},
        {"event": "embedding", "status": "progress", "done": 2, "total": 2}, {"event": "storing", "status": "start"}, {"event": "complete", "chunks": 2, "files": 2},
    ]
    status = call(w, "status")[1][0]
    assert status["chunks"] == 2 and status["by_project"] == {"projone": 2} and status["by_type"] == {"code": 1, "doc": 1}
    assert all(x["passed"] for x in call(w, "status", "--diagnose")[1][0])
    found = call(w, "query", "load path", "-l", "1")[1][0]
    assert found["total"] == 1 and set(found["results"][0]) == {"content", "source_file", "line_start", "line_end", "chunk_type", "language", "project", "score", "id"}
    assert call(w, "query", "load path", "-t", "doc")[1][0]["results"][0]["source_file"] == "b.md"
    monkeypatch.chdir(root)
    assert w.resolve() == ["projone"]
    assert call(w, "query", "load path", "-w")[1][0]["total"] >= 1 and len(call(w, "context", "load path", "-w")[1][0]["projects"]) == 1
    todo = call(w, "extract", "export", "--unextracted", "-p", "projone")[1][0]
    assert todo["files_count"] == 2 and todo["total"] == 2 and todo["filter"] == "unextracted"
    assert set(todo["files"][0]) == {"source_file", "language", "chunks"} and set(todo["files"][0]["chunks"][0]) == {"chunk_id", "content", "line_start", "line_end"}
    assert {k: v for k, v in call(w, "extract", "export", "-l", "1", "--offset", "1")[1][0].items() if k != "files"} == {"total": 2, "offset": 1, "limit": 1, "count": 1, "files_count": 1}
    up = tmp_path / "x.json"
    up.write_text(json.dumps({"entities": [{"name": "load", "entity_type": "function", "source_file": "a.py", "chunk_id": "c"}, {"name": "doc", "entity_type": "concept"}], "relations": [
        {"source_name": "doc", "source_type": "concept", "target_name": "load", "target_type": "function", "relation_type": "references"},
        {"source_name": "doc", "source_type": "concept", "target_name": "nobody", "target_type": "x", "relation_type": "references"}]}))
    assert call(w, "extract", "import", "-f", str(up), "-p", "projone")[1][0] == {"entities": 2, "relations": 1}
    assert call(w, "extract", "import", "-f", str(up), "-p", "projone")[1][0] == {"entities": 0, "relations": 1}  # edges are a bag
    assert call(w, "extract", "export", "--unextracted", "-p", "projone")[1][0]["files_count"] == 1
    shown = call(w, "graph", "show", "LOAD")[1][0]
    assert len(shown["incoming"]) == 2 and shown["outgoing"] == [] and "incoming" not in call(w, "graph", "deps", "doc")[1][0]
    assert call(w, "graph", "show", "nobody")[0] == 1
    assert call(w, "observe", "paths are loaded lazily", "-t", "decision", "--tags", "a, b", "-p", "projone")[0] == 0
    again = call(w, "query", "loaded lazily", "--recall")[1][0]["results"]
    assert again[0]["tags"] == ["a", "b"] and again[0]["valid_from"] == "2025-06-01T00:00:00"
    bundle = call(w, "context", "load path", "-p", "projone")[1][0]
    assert len(bundle["chunks"]) == 2 and len(bundle["entities"]) == 1 and len(bundle["observations"]) == 1
    assert [(x["direction"], x["entity"], x["relation"]) for x in bundle["entities"][0]["connections"]] == [("<--", "doc", "references")] * 2
    said = []
    run(w, parser().parse_args(["context", "load path"]), said.append)
    assert "return open(path)" in said[0] and "  - <-- doc (references)" in said[0] and "[decision] paths are loaded lazily (confidence 100%" in said[0] and "(python), similarity" in said[0]
    run(w, parser().parse_args(["context", "load path", "-p", "nobody"]), said.append)
    assert "(no chunk matches)" in said[1] and "(no entity of these files is known)" in said[1] and "(no observation matches)" in said[1]
    run(w, parser().parse_args(["graph", "show", "load", "-p", "projone"]), said.append)
    assert said[2].splitlines()[0] == "load (function)" and said[2].count("<-- references doc (concept)") == 2
    found = call(w, "review")[1][0]
    assert found["summary"] == {"warning": 0, "suggestion": 1, "info": 1} and {x["category"] for x in found["findings"]} == {"no_warnings", "no_description"} and found["observations"] == {"decision": 1}
    run(w, parser().parse_args(["review"]), said.append)
    assert "## No description" in said[3] and "[-] No warning is noted" in said[3] and "- observations, decision: 1" in said[3]
    (root / "b.md").unlink()
    assert call(w, "prune", str(root), "-p", "projone", "--dry-run")[1][0] == {"stale_files": ["b.md"], "chunks_deleted": 0, "entities_marked_stale": 0, "dry_run": True}
    assert call(w, "prune", str(root), "-p", "projone")[1][0] == {"stale_files": ["b.md"], "chunks_deleted": 1, "entities_marked_stale": 0} and call(w, "status")[1][0]["chunks"] == 1
    (root / "a.py").unlink()
    assert call(w, "prune", str(root), "-p", "projone")[1][0] == {"stale_files": ["a.py"], "chunks_deleted": 1, "entities_marked_stale": 1}
    assert call(w, "prune", str(root), "-p", "projone")[1][0] == {"stale_files": [], "chunks_deleted": 0, "entities_marked_stale": 0}
    up.write_text(json.dumps({"entities": [{"name": "Load", "entity_type": "module"}], "relations": []}))
    call(w, "extract", "import", "-f", str(up))
    with pytest.raises(AmbiguousEntity):
        w.graph("load")
    assert w.graph("load", project="projone")["entity"]["entity_type"] == "function"


def test_observations_are_listed_changed_and_ended(w):
    a, b = w.observe("first note", confidence=0.4), w.observe("second note", project="p")
    assert {r["id"] for r in w.list_observations()} == {a, b} and [r["id"] for r in w.list_observations(project="p")] == [b] and w.list_observations(1, 2) == []
    new = w.update_observation(a, content="all about pumps", confidence=0.9)
    assert (new["content"], new["confidence"], new["obs_type"]) == ("all about pumps", 0.9, "fact") and w.update_observation("nobody", content="x") is None
    assert w.recall("pumps", 1)["results"][0]["id"] == a  # its vector follows
    assert w.invalidate_observation(a)["valid_until"] == "2025-06-01T00:00:00" and w.invalidate_observation("nobody") is None
    assert [r["id"] for r in w.recall("pumps")["results"]] == [b]


def test_the_workspace_s_own_model_is_used_for_files(spark, w, tmp_path):
    def model(text):
        return [1.0, 0.0, float(len(text))]

    v = Workspace(spark, w.config, model)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("words")
    list(v.ingest(str(tmp_path / "x")))
    assert v.store.read("chunks").first()["embedding"] == [1.0, 0.0, 5.0] and v.query("words")["results"][0]["score"] == 1.0
    few = {**w.config, "embedding": {"dimensions": 8}}
    list(Workspace(spark, few).ingest(str(tmp_path / "x")))
    assert len(v.store.read("chunks").first()["embedding"]) == 8
    with pytest.raises(FileNotFoundError):
        list(v.ingest(str(tmp_path / "nowhere")))


def test_bundles_aren_t_cut(spark, w):
    from lodestack import schemas as S

    w.store.create()
    at = datetime(2025, 1, 1)
    w.store.write("chunks", spark.createDataFrame([("c", "text ``` " * 100, w.embedder("text"), "f.py", 1, 2, "code", "python", None, None, at, None)], S.CHUNKS))
    w.store.write("entities", spark.createDataFrame([(f"e{i}", f"n{i}", "m", "d", None, "f.py", None, at, at) for i in range(1000)], S.ENTITIES))
    w.store.write("relations", spark.createDataFrame([(f"r{i}", f"e{i}", "e0", "calls", 1.0, None, None) for i in range(1, 500)], S.RELATIONS))
    w.observe("long " * 200)
    said = []
    run(w, parser().parse_args(["context", "text"]), said.append)
    assert said[0].count("- **n") == 1000 and said[0].count("  - --> n0 (calls)") == 499 and said[0].count("  - <-- n") == 499 and "long " * 200 in said[0] and "text ``` " * 100 in said[0] and "````python" in said[0]


def test_a_commit_indexes_what_a_walk_would(w, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path / "g"), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    root = tmp_path / "g"
    (root / "skip").mkdir(parents=True)
    git("init")
    (root / "a.py").write_text("x = 1\n")
    git("add", ".")
    git("commit", "-m", "one")
    (root / ".gitignore").write_text("/skip/*.py\n")
    for name in ("a.py", "b.bin", "skip/c.py"):
        (root / name).write_text("y = 2\n")
    git("add", "-f", ".")
    git("commit", "-m", "two")
    assert w.ingest_commit(str(root), "p") == {"indexed": 1, "deleted": 0}
    assert [r["source_file"] for r in w.store.read("chunks").collect()] == ["a.py"] and len(w.list_observations()) == 1


def test_arguments():
    with pytest.raises(SystemExit):
        parser().parse_args(["query", "x", "--project", "p", "--workspace"])
    with pytest.raises(SystemExit):
        parser().parse_args(["reindex"])
    assert parser().parse_args(["query", "x"]).limit == 10 and parser().parse_args(["extract", "export"]).limit == 200


def test_asking_without_tables(w):
    with pytest.raises(LookupError):
        w.query("x")
