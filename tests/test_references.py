import random
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from lodestack import schemas as S
from lodestack.operators import references as R

A, B, C, D = ("00000000-0000-4000-8000-00000000000" + x for x in "abcd")
REMOVED = "record_table string, record_id string, removed_at timestamp_ntz"


def day(n):
    return datetime(2025, 3, n)


def entity(i, **k):
    base = dict(id=i, name="n", entity_type="t", description=None, project=None, source_file=None, properties=None, created_at=day(1), updated_at=day(2))
    return {**base, **k}


def chunk(i, path="f.py", project=None, at=None):
    return dict(id=i, content="x", embedding=None, source_file=path, line_start=1, line_end=1, chunk_type=None, language=None, project=project, checksum=None, indexed_at=at or day(1), metadata=None)


def relation(i, s, t, when='{"extracted_at": "2025-03-05T00:00:00Z"}'):
    return dict(id=i, source_id=s, target_id=t, relation_type="calls", weight=1.0, evidence=None, metadata=when)


def run(spark, relations=(), entities=(), chunks=(), removals=(), events=(), heavy=R.HEAVY_KEYS, wrap=lambda x: x):
    f = lambda rows, schema: wrap(spark.createDataFrame([tuple(r[c.name] for c in schema) for r in rows], schema))
    out = R.orphan_references(
        f(relations, S.RELATIONS), f(entities, S.ENTITIES), f(chunks, S.CHUNKS), wrap(spark.createDataFrame(list(removals), REMOVED)), wrap(spark.createDataFrame(list(events), S.FILE_EVENTS)), heavy
    )
    return sorted(tuple(r) for r in out.collect())


def test_states_spellings_and_months(spark):
    rel = [
        relation(A, B.upper(), "{" + C + "}"),  # there; missing
        relation(A, B, C.replace("-", "")),  # the same record again
        relation(B, D, None, '{"extracted_at": "2025-03-31T23:30:00-02:00"}'),  # removed; April in UTC
        relation(C, "no uuid", B, None),
        relation(D, B, B, '{"extracted_at": "2025-02-01 00:00:00"}'),  # target came later, both ends
    ]
    got = run(spark, rel, [entity(B)], removals=[("entities", D.upper(), day(3))])
    assert got == [
        ("relations", "source_id", B, D, "deleted", "2025-04"),
        ("relations", "source_id", C, "no uuid", "missing", "unknown"),
        ("relations", "source_id", D, B, "late", "2025-02"),
        ("relations", "target_id", A, C, "missing", "2025-03"),
        ("relations", "target_id", D, B, "late", "2025-02"),
    ]


def test_files_and_chunks_of_entities(spark):
    ents = [
        entity(A, source_file="a/f.py", project="p", properties=(["", A, None, A.upper()], None)),
        entity(B, source_file="gone.py", project=None),
        entity(C, source_file="", project="p", properties=(None, True)),
        entity(D, source_file="x/gone.py", project="q"),
    ]
    events = [("gone.py", "DELETE", day(3), 1), ("q/x/gone.py", "delete", day(3), 2), ("p/a/f.py", "modify", day(3), 3)]
    got = run(spark, entities=ents, chunks=[chunk(A, "a/f.py", "p", day(20))], events=events)
    assert got == [
        ("entities", "chunk_ids", A, "", "missing", "2025-03"),
        ("entities", "chunk_ids", A, A, "late", "2025-03"),
        ("entities", "source_file", A, "a/f.py", "late", "2025-03"),
        ("entities", "source_file", B, "gone.py", "deleted", "2025-03"),
        ("entities", "source_file", D, "x/gone.py", "deleted", "2025-03"),
    ]


def test_null_project_is_not_another_project(spark):
    got = run(spark, entities=[entity(A, source_file="f.py", project=None), entity(B, source_file="f.py", project="p")], chunks=[chunk(C, "f.py", None)])
    assert [(r[2], r[4]) for r in got] == [(B, "missing")]


def test_heavy_keys_give_the_same_rows(spark):
    rel = [relation(f"r{i}", A if i % 3 else f"k{i}", B) for i in range(60)]
    args = dict(relations=rel, entities=[entity(B)])
    assert run(spark, **args, heavy=1) == run(spark, **args, heavy=256)
    assert len(run(spark, **args, heavy=1)) == 60


def test_empty_tables_and_clashing_columns(spark, clash):
    assert run(spark) == []
    wrap = lambda df: clash(df, "kind", "key", "there", "removed", "us", "ref_key", "n", "raw")
    rel = [relation(A, C, B)]
    assert run(spark, rel, [entity(B)], wrap=wrap) == run(spark, rel, [entity(B)])


def test_counts_of_periods_equal_counted_rows(spark):
    """Also where a target came in the middle of a month in which it was referred to."""
    r = random.Random(3)
    there = [entity(f"e{i}", created_at=day(r.randint(1, 28))) for i in range(12)]
    rel = [relation(f"r{i}", f"e{r.randrange(16)}", f"e{r.randrange(16)}", r.choice([None, "{}", f'{{"extracted_at": "2025-0{r.randint(2, 4)}-{r.randint(10, 28)}T0{r.randint(0, 9)}:00:00Z"}}'])) for i in range(300)]
    f = lambda rows, schema: spark.createDataFrame([tuple(x[c.name] for c in schema) for x in rows], schema)
    gone = spark.createDataFrame([("entities", "e14", day(3))], REMOVED)
    for heavy in (1, 256):
        refs = R.References(f(rel, S.RELATIONS), f(there, S.ENTITIES), f([], S.CHUNKS), gone, spark.createDataFrame([], S.FILE_EVENTS), heavy)
        want = Counter((x[0], x[1], x[5], x[4]) for x in refs.orphans().collect())
        assert {tuple(x)[:4]: x[4] for x in refs.counts().collect()} == want and {k[3] for k in want} == {"late", "missing", "deleted"}


def test_times_don_t_depend_on_the_session(spark):
    df = spark.createDataFrame([(datetime(2025, 3, 30, 2, 30, 1, 5),), (datetime(1969, 12, 31, 23, 59, 59, 999999),), (None,)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # where this hour doesn't exist
        assert [x[0] for x in df.select(R.micros(F.col("t"))).collect()] == [1743301801000005, -1, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
