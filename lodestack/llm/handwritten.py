"""Generated, minified, vendored and data files among indexed source.

A file is a pair (project, source_file) of chunks. Evidence, in this order:

* *containment*: an inverted index over the lines of all files says where a line
  occurs. A file is contained in one of another project if it shares at least
  ``CONTAINED`` of its distinct lines of ``MIN_LINE`` characters and more, whatever
  was edited in between. All such pairs are found. Files that contain each other are copies of one
  source, and a mark goes on from a file to its copies and those contained in it, over as many links as there are. They are
  third-party if one of them has a mark of it (a directory or a header, below), or if copies that
  are hardly edited lie in ``SPREAD`` projects; so a copy comes out whose header was cut off and that was
  moved elsewhere.
* *marks* of files without a copy: a directory that by convention holds one library
  each, or a comment that names both a licence or its holder and a release or
  where it is published, as own files' headers don't.
* *token composition* of the remaining files, added up over the file: the share of
  characters in lines that hold nothing but literals and punctuation (data
  written down as code), in dense lines without blanks (minified, bundled), in
  lock-file entries, in parser tables and serialised descriptors; and comment
  lines that begin with a generator's mark. A mark quoted in a string, or in
  the middle of a remark, is none.

Scale: chunks become one small row of sums each and their line hashes. Files of the same
lines are one set, with the projects that hold it; sets are compared, so exact copies
make no pairs. Lines of one project only say nothing about others and are dropped. To share
half of its lines a set must share one of its rarest (all shared lines but as many as
half of its lines need, less one): only these are looked up in the index of all sets, and only for the pairs
they give shared lines are counted. A line of very many files is looked up only by sets
that consist of such lines by half. So the work follows the lines and the pairs that
exist; where many edited copies of one source contain each other, these pairs are as many as the
square of the copies, and each is counted. No file's lines are collected.

Cases: a null project is a project of its own (empty string in the result);
null paths or contents are no files; a repeated chunk id counts once, while
every chunk without an id counts; empty tables give empty results; extra columns
are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.columns import pick
from lodestack.session import spread, written

MIN_LINE = 12
CONTAINED = 0.5
#: Lines a file must have to be contained in another; and projects, lines and likeness of copies of a source that its spread alone tells.
FEW_LINES, SPREAD, SPREAD_LINES, SPREAD_ALIKE = 5, 4, 20, 0.8
DATA_SHARE, DENSE_SHARE, LOCK_SHARE, TABLE_SHARE = 0.6, 0.5, 0.5, 0.3

_COMMENT = re.compile(r"^\s*(?://+|/\*+!?|#+|--+|\*+|<!--|;+|%+)\s*(.*?)\s*(?:\*+/|-->)?\s*$")
#: How generators mark their output, in the languages seen in source.
_MARK = re.compile(
    r"(?i)^(?:@generated\b|<auto-generated>|auto-?\s?generated\b|automatically generated|code generated\b|generated (?:by|from|code|file)\b"
    r"|this (?:file|code|module|class) (?:is|was) (?:machine[ -](?:written|generated|made)|auto-?(?:matically )?[- ]?generated|generated|produced|created by)"
    r"|do not edit\b|machine[ -]generated|automatisch (?:erzeugt|generiert|erstellt)|g[eé]n[eé]r[eé] (?:automatiquement|par)|fichier g[eé]n[eé]r[eé]"
    r"|(?:archivo|fichero|c[oó]digo) generado|generado (?:autom[aá]ticamente|por)|erzeugt (?:von|aus|durch)|generiert (?:von|aus|durch))"
)
#: What a header says of third-party source: under which licence, whose it is, which release, where it is published.
_SAYS = {
    "licence": re.compile(r"(?i)\bSPDX-|\blicen[cs]ed?\b|\bpermission (?:to use|is hereby)|\ball rights reserved\b|\bredistribution and use\b|\bfree software\b|\bCOPYING\b"),
    "holder": re.compile(r"(?i)\bcopyright\b|\(c\)|©|\bcontributors\b|\bmaintainers\b|\bdevelopers\b|\bauthors\b"),
    "release": re.compile(r"(?i)(?:^|[\s@\-])v?\d+\.\d+(?:\.\d+)+\b|@version\b|\b(?:release|version) \d"),
    "origin": re.compile(r"(?i)\bupstream\b|https?://|\bhomepage\b|\brepository\b"),
}
_LICENCE_NUMBER = re.compile(r"(?i)licen[cs]es?,?\s+(?:version|v\.?)?\s*\d[\d.]*")
_QUOTES = re.compile(r"^\s*[rRuU]?(\"\"\"|\'\'\')")
#: Directories that hold one third-party library each, and the library's name.
_VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|third_party|third-party|external|deps|node_modules|bower_components|contrib/upstream|static/lib)/((?:@[\w.\-]+/)?[\w.\-]+)")

_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""")
_LITERAL = re.compile(r"\b0[xX][0-9a-fA-F]+\b|\b\d[\d_.]*(?:[eE][+-]?\d+)?\b|\b(?:true|false|null|None|True|False|nil)\b")
_LOCK_LINE = re.compile(
    r"""(?x)^\s*(?:"?(?:lockfileVersion|lockfile|resolved|integrity|checksum|resolution|hash|version|source|packages|dependencies|dev|requires|optional|peer|engines)"?\s*[:=]
    |"(?:deps|node_modules)/[^"]+"\s*:\s*\{|\[\[package\]\]|/?@?[\w.\-/]+@\d[\w.\-]*:|"[^"]+@[^"]+":)"""
)
_LOCK_PROOF = re.compile(r"(?i)lockfile|sha(?:1|256|384|512)-[A-Za-z0-9+/=]{20,}|\[\[package\]\]|checksum\s*=\s*\"[0-9a-f]{40,}|--hash=sha256:")
_TABLE = re.compile(r"\byy[a-z]{1,12}(?:_\d+)?\b|_serialized_(?:start|end|options)\b|AddSerializedFile\(|goto yy|_sym_db\b")
_CODE = re.compile(r"(?i)\.(?:py|js|jsx|mjs|cjs|ts|tsx|go|c|h|cc|cpp|hpp|java|rs|rb|php|cs|kt|swift|scala|lua|pl|r|sh|bash|sql|m|vue)$")
_STYLE = re.compile(r"(?i)\.(?:css|scss|less)$")
_TEXT = re.compile(r"(?i)\.(?:md|rst|txt|adoc|html?)$")

SUMS = ["chars", "data", "dense", "lock", "proof", "table", "marks", "heads"]
CHUNK_FIELDS = [("id", pa.string()), ("project", pa.string()), ("source_file", pa.string())] + [(s, pa.int64()) for s in SUMS] + [("lines", pa.list_(pa.int64()))]
CHUNK_SCHEMA = "id string, project string, source_file string, " + ", ".join(f"{s} bigint" for s in SUMS) + ", lines array<bigint>"


def is_data_line(line: str) -> bool:
    """Nothing but literals and punctuation; keys of a record are strings."""
    rest = _LITERAL.sub("", _STRING.sub("", line))
    return not re.search(r"[A-Za-z_$]", rest)


def is_dense_line(line: str) -> bool:
    """A long line of code squeezed together: many separators, few blanks, short names."""
    if len(line) < 160:
        return False
    bare = _STRING.sub('""', line)
    if len(bare) < 0.4 * len(line):
        return False
    marks = sum(bare.count(c) for c in "{};:=(),")
    return marks >= len(bare) / 16 and bare.count(" ") + bare.count("\t") <= len(bare) * 0.09


def is_third_party_header(said: list[str]) -> bool:
    """Whether the lines of one comment name a licence or its holder, and a release or an origin."""
    whole = [_LICENCE_NUMBER.sub("licence", x) for x in said]
    has = {k: any(rx.search(x) for x in whole) for k, rx in _SAYS.items()}
    return (has["licence"] or has["holder"]) and (has["release"] or has["origin"])


def chunk_facts(path: str, content: str) -> tuple[list[int], np.ndarray]:
    """Sums and hashes of lines of one chunk."""
    n = dict.fromkeys(SUMS, 0)
    lines, said = [], []
    text = bool(_TEXT.search(path))
    block, quoted = False, ""

    def close():
        n["heads"] += len(said) > 1 and is_third_party_header(said)
        said.clear()

    for line in content.split("\n"):
        s = line.strip()
        if not s:
            continue
        size = len(s)
        n["chars"] += size
        flat = " ".join(s.split()).lower()
        if len(flat) >= MIN_LINE:
            lines.append(xxhash.xxh3_64_intdigest(flat))
        if text:
            continue
        # a text of its own between triple quotes is a comment too
        opens = None if quoted else _QUOTES.match(line)
        if quoted or opens:
            said.append(s)
            if opens and s.count(opens.group(1)) == 1:
                quoted = opens.group(1)
            elif quoted and quoted in s:
                quoted = ""
        m = _COMMENT.match(line)
        starred = s.startswith("*") and block
        if s.startswith("/*"):
            block = "*/" not in s
        elif "*/" in s:
            block = False
        if m and (not s.startswith("*") or starred or s.startswith("* ")):
            said.append(m.group(1))
            n["marks"] += bool(_MARK.match(said[-1]))
            continue
        if s == "*/":
            continue
        if not quoted and not opens:
            close()
        if _TABLE.search(s):
            n["table"] += size
        elif is_dense_line(s):
            n["dense"] += size
        elif is_data_line(s):
            n["data"] += size
        if _LOCK_LINE.match(s):
            n["lock"] += size
            n["proof"] += bool(_LOCK_PROOF.search(s))
    close()
    return [n[k] for k in SUMS], np.array(sorted(set(lines)), np.uint64).view(np.int64)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(CHUNK_FIELDS)
    for b in batches:
        cols = [[] for _ in CHUNK_FIELDS]
        for i, p, f, c in zip(*(b.column(k).to_pylist() for k in ("id", "project", "source_file", "content"))):
            sums, lines = chunk_facts(f, c)
            for col, v in zip(cols, [i, p, f, *sums, lines]):
                col.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, CHUNK_FIELDS)], schema=schema)


def in_library(path: str) -> bool:
    """Whether the path goes through a directory of one library within one for such."""
    m = _VENDOR_DIR.search(path)
    return bool(m) and path[m.end(1) :][:1] == "/"


def composition(n: dict, path: str) -> str | None:
    """What the sums of a file say it is: generated, minified, lock, data or None."""
    total = max(1, n["chars"])
    if n["marks"] and not _TEXT.search(path):
        return "generated"
    if n["proof"] and n["lock"] >= LOCK_SHARE * total:
        return "lock"
    if _CODE.search(path) or _STYLE.search(path):
        if n["dense"] >= DENSE_SHARE * total:
            return "minified"
        if n["table"] and n["table"] + n["data"] >= TABLE_SHARE * total and n["table"] >= 0.04 * total:
            return "generated"
        if _CODE.search(path) and n["data"] >= DATA_SHARE * total:
            return "data"
    return None


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        kind = [composition(r, r["source_file"]) for r in rows]
        mark = ["directory" if in_library(r["source_file"]) else "header" if r["heads"] else None for r in rows]
        code = [bool(_CODE.search(r["source_file"]) or _STYLE.search(r["source_file"])) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [b.column("project"), b.column("source_file"), pa.array(kind, pa.string()), pa.array(mark, pa.string()), pa.array(code, pa.bool_())],
            names=["project", "source_file", "composed", "mark", "code"],
        )


class SourceFiles:
    """``verdicts``: one row per file that no one of its project wrote by hand; ``contained``: pairs of a file and
    one of another project that holds enough of its lines, with the exact shares of both."""

    def __init__(self, chunks: DataFrame, contained: float = CONTAINED, spread_projects: int = SPREAD):
        rows = (
            pick(chunks, "id", "project", "source_file", "content").where(F.col("source_file").isNotNull() & F.col("content").isNotNull())
            .select("id", F.coalesce("project", F.lit("")).alias("project"), "source_file", "content")
        )
        # copies of an id are dropped from the facts, which are smaller than the texts
        facts = spread(rows).mapInArrow(_facts, CHUNK_SCHEMA)
        # rows without an id are no copies of each other
        facts = facts.withColumn("own", F.when(F.col("id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["id", "own"]).drop("id", "own")
        # files go by hashes from here: what is shuffled per line is two numbers
        file, place = F.xxhash64("project", "source_file"), ["set", "project_no"]
        facts = written(facts.withColumn("file", file), "chunk-facts")
        # neighbouring chunks share lines
        lines = written(facts.select("file", F.explode("lines").alias("line")).repartition("file").distinct(), "lines")
        # files of the same lines are one set
        sets = lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.bit_xor("line").alias("x"), F.bit_xor(F.xxhash64("line")).alias("y"))
        sets = sets.select("file", "n_lines", F.xxhash64("n_lines", "x", "y").alias("set"))
        files = (
            facts.groupBy("project", "source_file").agg(*(F.sum(s).alias(s) for s in SUMS))
            .mapInArrow(_verdicts, "project string, source_file string, composed string, mark string, code boolean")
            .withColumns({"file": file, "project_no": F.xxhash64("project")})
        )
        files = written(files.join(sets, "file", "left"), "files")
        held = files.where(F.col("set").isNotNull())
        sets = held.groupBy("set").agg(F.min("n_lines").alias("n_lines"), F.min("project_no").alias("low"), F.max("project_no").alias("high"), F.min("file").alias("file"))
        sets = written(sets, "sets")
        places = written(held.groupBy(*place).agg(F.max("code").alias("code"), F.max(F.col("mark").isNotNull()).alias("marked")), "places")
        edges = written(self._edges(lines, sets, contained), "contained")
        names = held.select("set", "project", "source_file")
        pairs = edges.join(names, "set").join(names.toDF("other", "in_project", "in_file"), "other").where("project <> in_project")
        self.contained = pairs.select("project", "source_file", "in_project", "in_file", "containment", "back")
        # what marks one copy marks all: it goes from a set to those contained in it, always to another project
        hold = edges.where(F.col("back") >= contained)
        ways = edges.select(F.col("other").alias("at"), "set", "containment").unionByName(hold.select(F.col("set").alias("at"), F.col("other").alias("set"), F.lit(None).cast("double").alias("containment")))
        ways = written(ways.groupBy("at", "set").agg(F.max("containment").alias("containment")), "ways")
        elsewhere = (F.col("project_no") != F.col("low")) | (F.col("project_no") != F.col("high"))

        def led(sources: DataFrame) -> DataFrame:
            """The places that ways lead to, from sets given with the range of their projects."""
            return ways.join(sources.withColumnRenamed("set", "at"), "at").join(places.select(*place), "set").where(elsewhere)

        alike = hold.where((F.col("containment") >= SPREAD_ALIKE) & (F.col("back") >= SPREAD_ALIKE) & (F.col("n_lines") >= SPREAD_LINES))
        near = alike.join(places.where("code").select(*place), "set").select(F.col("other").alias("set"), "project_no").distinct()
        many = near.groupBy("set").agg(F.count("*").alias("n")).where(F.col("n") >= spread_projects - 1)
        # one's own project doesn't count
        wide = places.select(*place).join(many, "set").join(near.withColumn("own", F.lit(1)), place, "left").where(F.col("n") - F.coalesce("own", F.lit(0)) >= spread_projects - 1)
        reached = written(wide.select(*place), "wide")
        last = places.where("marked").select(*place).unionByName(reached)
        while True:
            sources = last.groupBy("set").agg(F.min("project_no").alias("low"), F.max("project_no").alias("high"))
            last = written(led(sources).select(*place).distinct().join(reached, place, "left_anti"), "reached")
            if last.isEmpty():
                break
            reached = reached.unionByName(last)
        third = reached.withColumn("third", F.lit(True))
        best = led(sets.select("set", "low", "high")).groupBy(*place).agg(F.max("containment").alias("containment")).withColumn("copied", F.lit(True))
        full = files.join(third, place, "left").join(best, place, "left")
        copied = (F.col("third").isNotNull() | F.col("mark").isNotNull()) & F.col("copied").isNotNull()
        evidence = F.when(copied, "containment").when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("composed").isNotNull(), "composition")
        self.verdicts = (
            full.withColumn("evidence", evidence).where(F.col("evidence").isNotNull())
            .select("project", "source_file", F.when(F.col("evidence") == "composition", F.col("composed")).otherwise("vendored").alias("kind"), "evidence", F.col("mark").isNotNull().alias("marked"), F.when(copied, F.col("containment")).alias("containment"))
        )

    @staticmethod
    def _edges(lines: DataFrame, sets: DataFrame, contained: float) -> DataFrame:
        """All pairs of sets of two projects of which the first is contained in the other; a set of several projects is so in itself."""
        rows = lines.join(sets, "file").select("set", "line", "n_lines", "low", "high")
        index = rows.groupBy("line").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("n_sets")).where("first <> last")
        shared = rows.join(index.select("line", "n_sets"), "line")
        order = Window.partitionBy("set")
        shared = shared.withColumns({"k": F.count("*").over(order), "r": F.row_number().over(order.orderBy("n_sets", "line"))})
        # the share is a quotient, which rounding may put below a whole number of lines
        shared = written(shared.withColumn("need", F.greatest(F.ceil(contained * F.col("n_lines") - 1e-6), F.lit(1))), "shared-lines")
        rare = shared.where((F.col("n_lines") >= FEW_LINES) & (F.col("r") <= F.col("k") - F.col("need") + 1)).select("line", "set", "need", "low", "high")
        others = shared.select("line", F.col("set").alias("other"), F.col("k").alias("other_k"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
        apart = F.least("low", "other_low") != F.greatest("high", "other_high")
        pairs = rare.join(others, "line").where((F.col("set") != F.col("other")) & (F.col("other_k") >= F.col("need")) & apart)
        pairs = written(pairs.select("set", "other").distinct(), "pairs")
        mine, theirs = shared.select("set", "line"), shared.select(F.col("set").alias("other"), "line")
        both = pairs.join(mine, "set").join(theirs, ["other", "line"]).groupBy("set", "other").agg(F.count("*").alias("n_shared"))
        n_lines = sets.select("set", "n_lines")
        both = both.join(n_lines, "set").join(n_lines.toDF("other", "n_other"), "other")
        both = both.select("set", "other", "n_lines", (F.col("n_shared") / F.col("n_lines")).alias("containment"), (F.col("n_shared") / F.col("n_other")).alias("back"))
        itself = sets.where("low <> high").select("set", F.col("set").alias("other"), "n_lines", F.lit(1.0).alias("containment"), F.lit(1.0).alias("back"))
        return both.unionByName(itself).where((F.col("containment") >= contained) & (F.col("n_lines") >= FEW_LINES))


def not_handwritten(chunks: DataFrame) -> DataFrame:
    return SourceFiles(chunks).verdicts
