import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestack import schemas as S
from lodestack import session
from lodestack.functions import text as X
from lodestack.functions.embed import hashing_embedder
from lodestack.operators import chunking, graph, review, search, store
from lodestack.operators.ingest import Indexer
from lodestack.sources import config, git
from lodestack.sources.files import read_extraction
from lodestack.sources.ignore import Ignore, rerooted, should_ignore
from lodestack.streaming import changes

NOW = None


@pytest.fixture(autouse=True)
def _now(spark):
    global NOW
    NOW = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("path,lang,kind", [("main.py", "python", "code"), ("README.md", "markdown", "doc"), ("app.tsx", "typescript", "code"), ("data.xyz", None, "doc"), (".gitignore", None, "doc"), ("a.b/c", None, "doc"), ("X.PY", "python", "code")])
def test_language(spark, path, lang, kind):
    assert one(spark, path, X.language) == lang and one(spark, path, X.chunk_type) == kind


def test_checksum_and_preview(spark):
    assert len(one(spark, "ß😀", X.checksum)) == 16 and one(spark, "a", X.checksum) != one(spark, "b", X.checksum)
    assert one(spark, "a\nb", X.preview) == "a b" and one(spark, "x" * 201, X.preview) == "x" * 200 + "..."
    assert one(spark, "a, b,,c ", lambda c: F.array_join(X.tag_list(c), "|")) == "a|b||c"


def test_like_prefix_keeps_backslashes_and_wildcards(spark):
    df = spark.createDataFrame([("a\\b/x",), ("a_b/x",), ("acb/x",)], "p string")
    assert df.where(X.like_prefix(F.col("p"), "a\\b")).count() == 1 and df.where(X.like_prefix(F.col("p"), "a_b")).count() == 3


def vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0]), ("e", None), ("f", [1.0, 0.0, 0.0]), ("g", [float("nan"), 1.0]), ("h", [1.0, 1.0])]
    return spark.createDataFrame([(i, "t", v, "f", None, 2, "code", None, "p" if i < "c" else None, None, None, None) for i, v in rows], S.CHUNKS)


def test_top_k(spark):
    df = vectors(spark)
    ids = lambda x: [r["id"] for r in x.collect()]
    assert ids(search.search_chunks(df, [1.0, 0.0], 10)) == ["a", "b", "h", "c"]  # the negative is dropped, a zero vector goes last
    assert ids(search.search_chunks(df, [1.0, 0.0], 10, threshold=-1.0)) == ["a", "b", "h", "d", "c"]
    assert ids(search.search_chunks(df, [1.0, 0.0], 2)) == ids(search.search_chunks(df, [1.0, 0.0], 3))[:2]
    assert ids(search.search_chunks(df, [1.0, 0.0], 3, threshold=0.9)) == ["a"]
    assert ids(search.search_chunks(df, [1.0, 0.0], 3, project=[])) == [] and ids(search.search_chunks(df, [1.0, 0.0], 3, project="")) == ["a", "b", "h"]


def entities(spark, rows):
    return spark.createDataFrame([(i, n, t, d, p, f, (c, None), datetime(2025, 1, 1), datetime(2025, 1, 1)) for i, n, t, d, p, f, c in rows], S.ENTITIES)


def relations(spark, rows):
    return spark.createDataFrame([(i, s, t, "calls", 1.0, None, None) for i, s, t in rows], S.RELATIONS)


def test_upsert_appends_and_is_idempotent(spark):
    old = entities(spark, [("1", "a", "m", "x", None, "f", ["c1"]), ("2", "b", "m", None, "p", None, None)])
    schema = "name string, entity_type string, description string, source_file string, chunk_id string, project string, ordinal int"
    batch = spark.createDataFrame([("a", "m", "first", "g", "c2", None, 0), ("a", "m", "last", "h", "c1", None, 1), ("n", "m", None, None, None, "p", 2)], schema)
    once = graph.upsert_entities(old, batch, NOW)
    rows = {r["name"]: r for r in once.collect()}
    assert rows["a"]["description"] == "last" and rows["a"]["source_file"] == "h" and sorted(rows["a"]["properties"]["chunk_ids"]) == ["c1", "c2"]
    assert rows["b"]["description"] is None and rows["n"]["description"] == "" and len(rows) == 3
    twice = graph.upsert_entities(spark.createDataFrame(once.collect(), S.ENTITIES), batch, NOW)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_graph(spark):
    e = entities(spark, [(i, i, "m", "", None, None, None) for i in "abcd"])
    r = relations(spark, [("1", "a", "b"), ("2", "b", "c"), ("3", "b", "b"), ("4", "c", "zz")])
    assert [x["id"] for x in graph.orphans(e, r).collect()] == ["d"]
    loop = graph.connections(e.where("id = 'b'"), r, e).collect()
    assert sorted((x["direction"], x["other_id"]) for x in loop) == [("-->", "b"), ("-->", "c"), ("<--", "a"), ("<--", "b")]
    assert {(x["id"], x["hops"]) for x in graph.k_hop(e.where("id = 'a'"), r, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("zz", 3)}
    assert [x["id"] for x in graph.cascade(r, e.where("id = 'c'")).collect()] == ["1", "3"]
    assert graph.find_entity(e, "A")["id"] == "a" and graph.find_entity(e, "nobody") is None
    with pytest.raises(graph.AmbiguousEntity):
        graph.find_entity(e.unionByName(e), "a")


def test_invalidated_is_not_active(spark):
    t = datetime(2025, 1, 1)
    o = spark.createDataFrame([(i, "c", None, "fact", None, None, None, 1.0, t, None, None) for i in "ab"], S.OBSERVATIONS)
    after = store.invalidate(o, spark.createDataFrame([("a",), ("zz",)], "id string"), NOW)
    assert [r["id"] for r in after.where(search.active(NOW)).collect()] == ["b"]
    patched = store.patch_observations(o, spark.createDataFrame([("a", "new", None)], "id string, content string, confidence double"))
    assert {(r["id"], r["content"], r["confidence"]) for r in patched.collect()} == {("a", "new", 1.0), ("b", "c", 1.0)}


def test_findings_of_nothing(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in S.TABLES.items()}
    assert review.findings(empty["chunks"], empty["entities"], empty["relations"], empty["observations"], NOW).count() == 0


def test_windows_cover_the_text(spark):
    texts = ["", "   \n", "x" * 1024, "ab\n" * 900, "ß😀" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = chunking.windows(df, "text").orderBy("i", "pos").collect()
    assert {r["i"] for r in got} == {2, 3, 4}
    for i in (2, 3, 4):
        parts = [r["content"] for r in got if r["i"] == i]
        assert parts[0] + "".join(p[200:] for p in parts[1:]) == texts[i]


def test_ignore_rules():
    assert should_ignore(".git/config", [".git"]) and should_ignore("a/node_modules/x.js", ["node_modules"]) and not should_ignore("src/main.py", [".git"])
    ig = Ignore(["*.log", "!keep.log", "/top", "a/**/z", "dir/"])
    assert ig("x/y.log") and not ig("x/keep.log") and ig("top/f") and not ig("x/top") and ig("a/b/c/z") and ig("dir/f") and not ig("dir2/f")
    assert rerooted("/x", "d") == "d/x" and rerooted("x", "d") == "d/**/x" and rerooted("!a/b", "d") == "!d/a/b" and rerooted("x", ".") == "x" and rerooted("x/", "d") == "d/**/x/" and rerooted("!/a/", "d") == "!d/a/"


def test_config_order(tmp_path):
    at = tmp_path / "lodestack.toml"
    at.write_text('[embedding]\ndimensions = 8\n[store]\nroot = "file"\n')
    got = config.load(at, {"LODESTACK_STORE__ROOT": "env"})
    assert got["embedding"]["dimensions"] == 8 and got["store"]["root"] == "env" and got["chunking"]["size"] == 1024


def test_extraction_file(spark, tmp_path):
    good = tmp_path / "a.json"
    good.write_text('{"entities": [{"name": "a", "entity_type": "m"}], "relations": []}')
    ent, rel = read_extraction(spark, str(good))
    assert ent.first()["description"] == "" and rel.count() == 0
    (tmp_path / "b.json").write_text('{"entities": [{"name": "a"}], "relations": []}')
    with pytest.raises(Exception, match="entity_type"):
        read_extraction(spark, str(tmp_path / "b.json"))[0].collect()


def test_ingest_prune_and_reindex(spark, tmp_path):
    root, at = tmp_path / "w", tmp_path / "s"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("def f():\n    return 1\n")
    (root / "b.md").write_bytes(b"# t\n\nbad \xff byte.\n")
    (root / "empty.py").write_text("  \n")
    (root / "node_modules" / "x.js").write_text("x")
    (root / "c.bin").write_text("x")
    s = store.Store(spark, f"file://{at}")
    s.create()
    s.create()
    index = Indexer(spark, s)
    assert list(index.ingest(str(root), "p"))[-1] == {"event": "complete", "chunks": 2, "files": 2}
    assert list(index.ingest(str(root), "p"))[-1] == {"event": "complete", "chunks": 2, "files": 2} and s.read("chunks").count() == 2  # replaced, not added
    rows = {r["source_file"]: r for r in s.read("chunks").collect()}
    assert rows["a.py"]["language"] == "python" and "�" in rows["b.md"]["content"] and len(rows["a.py"]["embedding"]) == 64
    (root / "a.py").write_text("")
    assert index.ingest_paths(str(root), ["a.py", "c.bin", "node_modules/x.js"], "p") == {"indexed": 1, "deleted": 0}
    assert [r["source_file"] for r in s.read("chunks").collect()] == ["b.md"]
    os.remove(root / "b.md")
    assert index.prune(str(root), "q", dry_run=True)["stale_files"] == [] and index.prune(str(root), "p") == {"stale_files": ["b.md"], "chunks_deleted": 1, "entities_marked_stale": 0} and s.read("chunks").count() == 0
    assert s.missing() == []


def test_debounce_keeps_the_last_action(spark):
    t = datetime(2025, 1, 1)
    ev = spark.createDataFrame([("f", "create", t, 2), ("f", "MODIFY", t + timedelta(minutes=5), 1), ("f", "delete", t + timedelta(hours=2), 3), ("g", "create", t, 4)], S.FILE_EVENTS)
    assert sorted((r["path"], r["action"], r["n_events"]) for r in changes.debounced(ev).collect()) == [("f", "delete", 1), ("f", "modify", 2), ("g", "create", 1)]


def test_folder_stream_sees_modify_and_delete(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.py").write_text("x = 1\n")
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.create()
    (root / ".gitignore").write_text("b_*.py\n")
    q = changes.watch(Indexer(spark, s), str(root), str(tmp_path / "cp"), "p", "200 milliseconds")
    try:
        q.processAllAvailable()
        assert [r["source_file"] for r in s.read("chunks").collect()] == ["a.py"]
        (root / "b.py").write_text("y = 2\n")
        (root / "b_ignored.py").write_text("y = 2\n")
        (root / "b.bin").write_text("y = 2\n")
        os.remove(root / "a.py")
        q.processAllAvailable()
        assert [r["source_file"] for r in s.read("chunks").collect()] == ["b.py"]
    finally:
        q.stop()
    assert q.activity.counts == {"create": 2, "delete": 1}
    offsets = [f.read_text() for f in (tmp_path / "cp" / "offsets").iterdir() if f.name.isdigit()]
    assert offsets and all(len(x) < 1000 and "a.py" not in x for x in offsets) and len(list((tmp_path / "cp" / "listings").iterdir())) <= 2


def test_two_writers_lose_nothing(spark, tmp_path):
    s, other = store.Store(spark, f"file://{tmp_path}/s"), store.Store(spark, f"file://{tmp_path}/s")
    s.create()
    row = lambda i: spark.createDataFrame([(i, "c", None, "fact", None, None, None, 1.0, datetime(2025, 1, 1), None, None)], S.OBSERVATIONS)
    held, calls = s.read("observations"), []

    def change(old):
        if not calls:  # another one is first, between this one's read and its write
            other.append("observations", row("b"))
        calls.append(1)
        return old.unionByName(row("a"))

    assert s.update("observations", change) == 3 and len(calls) == 2
    assert sorted(r["id"] for r in s.read("observations").collect()) == ["a", "b"] and held.count() == 0
    folders = set((tmp_path / "s" / "observations").glob("v-*"))
    s.append("observations", row("c"))
    (new,) = set((tmp_path / "s" / "observations").glob("v-*")) - folders  # nothing is rewritten
    assert s.read("observations").count() == 3 and spark.read.parquet(str(new)).count() == 1
    with pytest.raises(LookupError):
        store.Store(spark, f"file://{tmp_path}/nowhere").read("chunks")


def test_chunks_of_prose_overlap_by_sentences():
    text = " ".join(f"Sentence number {i} says something about the pump." for i in range(100))
    parts = chunking.chunk_text(text, "markdown", 400, 120)
    assert all(len(p) <= 400 for p in parts)
    for a, b in zip(parts, parts[1:]):
        both = next(n for n in range(120, 0, -1) if a.endswith(b[:n]))
        assert both > 40 and b.lstrip().startswith("Sentence")
    rows = chunking.located(text, parts)
    assert all(r[1] == 1 for r in rows) and "".join(p[next((n for n in range(120, 0, -1) if a.endswith(p[:n])), 0) :] for a, p in zip(["", *parts], parts)) == text
    wide = chunking.chunk_text("y" * 1000 + ". End of it.", "text", 400, 100)
    assert [len(p) for p in wide[:3]] == [400, 400, 400] and "End" in wide[-1] and all(len(p) <= 400 for p in wide)


def test_git_fallbacks(spark, tmp_path):
    assert git.commit_info(str(tmp_path))["hash"] == "unknown" and git.changed_paths(spark, str(tmp_path)).count() == 0
    o = git.commit_observation({"hash": "0123456789", "author": "a <b>", "message": "m", "date": "d"}, ["x"], None)
    assert o["content"] == "Commit 01234567: m (1 files) by a <b>"


def test_shared_folder_and_written_tables(spark, monkeypatch):
    given = spark.conf.get(session.CHECKPOINT_KEY, None)
    assert not given or session.shared_dir(spark) == given
    monkeypatch.setattr(session, "CHECKPOINT_KEY", "lodestack.not.set")
    own = session.shared_dir(spark)
    assert own.startswith("file:///") and session.shared_dir(spark) == own and os.path.isdir(own[7:])
    a = session.written(spark.range(3).toDF("id"), "a")
    b = session.written(a, "b")
    session.discard(a)
    assert len(os.listdir(own[7:])) == 1 and b.count() == 3
    session.discard(b)
    assert os.listdir(own[7:]) == []


def test_hashing_embedder():
    v = hashing_embedder("some words here")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == hashing_embedder("some words here") and not any(hashing_embedder("..."))
