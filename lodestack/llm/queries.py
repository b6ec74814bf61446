"""Queries of the text operators, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.llm import handwritten, mixing, neardup, packing, quality, secrets, splitting, vectors
from lodestack.session import table


def contents(spark: SparkSession, d: str) -> DataFrame:
    """src_table, id, content of chunks and observations."""
    parts = [table(spark, d, t).select(F.lit(t).alias("src_table"), "id", "content") for t in ("chunks", "observations")]
    return parts[0].unionByName(parts[1])


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """src_table, id, embedding of chunks and observations."""
    parts = [table(spark, d, t).select(F.lit(t).alias("src_table"), "id", "embedding") for t in ("chunks", "observations")]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "chunks")).select("project", "source_file")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "chunks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(embedded(spark, d))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.Neighbours(embedded(spark, d)).neighbours()


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Who is nearest to whom, without similarities and ranks, which rounding would tell apart."""
    return p3_neighbours(spark, d).select("src_table", "id", "neighbour")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credential_lines(table(spark, d, "chunks"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(table(spark, d, "chunks")).withColumn("line_nos", F.array_join(F.col("line_nos").cast("array<string>"), ","))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(contents(spark, d)).pairs()


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(contents(spark, d)).groups()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "chunks"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each text cover, and whether they fit, come in order and are the text's own."""
    chunks = table(spark, d, "chunks")
    pieces = splitting.split_oversized(chunks)
    texts = chunks.select(F.col("id").alias("chunk_id"), F.col("content").alias("whole")).where(F.length("whole") > splitting.LIMIT).dropDuplicates(["chunk_id"])
    row = Window.partitionBy("chunk_id").orderBy("piece_no")
    before = F.lag("char_end").over(row)
    size = F.col("char_end") - F.col("char_start")
    each = pieces.join(texts, "chunk_id").select(
        "chunk_id", "char_start", "char_end", (size <= splitting.LIMIT).alias("fits"), (F.col("content") == F.substr("whole", F.col("char_start") + 1, size)).alias("own"),
        F.coalesce((F.col("char_start") <= before) & (F.col("char_start") >= before - splitting.OVERLAP), F.col("char_start") == 0).alias("joined"),
    )
    return each.groupBy("chunk_id").agg(F.min("char_start").cast("bigint").alias("starts_at"), F.max("char_end").cast("bigint").alias("covered"), F.min("fits").alias("fits"), F.min("own").alias("own_text"), F.min("joined").alias("joined"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packing(spark, d), table(spark, d, "pack_sizes"))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document is packed for every container, none beyond capacity, none divided that fits."""
    packed, sizes = p7_packing(spark, d), table(spark, d, "pack_sizes").select("container", F.col("capacity_tokens").alias("capacity"))
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("filled")).groupBy("container").agg(F.max("filled").alias("fullest"))
    docs = packed.groupBy("container", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    docs = docs.join(F.broadcast(sizes), "container").groupBy("container").agg(F.count("*").alias("n_documents"), F.min((F.col("n") == 1) | (F.col("tokens") > F.col("capacity"))).alias("whole"))
    return docs.join(bins, "container").join(sizes, "container").select("container", "n_documents", "whole", (F.col("fullest") <= F.col("capacity")).alias("fits"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source keeps to its budget and repeats."""
    m = mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    kept = F.col("most_uses") <= F.col("max_repeats")
    return m.report.select("source", F.col("target_share").alias("asked"), F.col("max_repeats").alias("repeats"), kept.alias("kept"), ((F.col("missing_tokens") >= 0) & (F.col("reached_share") <= 1)).alias("within"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.no_prose(table(spark, d, "documents"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"))


def p9_counts(spark: SparkSession, d: str) -> DataFrame:
    """Those of the statistics that SQL can state."""
    return p9_statistics(spark, d).select("doc_id", "n_chars", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.col("rule").eqNullSafe("blank").alias("blank"))


QUERIES = {
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p7_whole": p7_whole,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_limits": p8_limits,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
    "p9_counts": p9_counts,
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_nearest": p3_nearest,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_coverage": p6_coverage,
}
#: Every vector against every other of its table, in double precision; vectors equal to six digits once scaled are one.
_P3_PAIRS = """
WITH v AS (
  SELECT src_table, id, any_value(CAST(embedding AS DOUBLE[])) AS e
  FROM (SELECT 'chunks' AS src_table, id, embedding FROM chunks UNION ALL SELECT 'observations', id, embedding FROM observations)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY src_table, id
), w AS (
  SELECT src_table, id, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v WHERE list_inner_product(e, e) > 0
), k AS (SELECT *, list_transform(e, lambda x: round(x, 6)) AS same FROM w),
h AS (SELECT src_table, d, same, arg_min(e, id) AS e FROM k GROUP BY ALL),
u AS (SELECT k.src_table, k.id, k.d, h.e FROM k JOIN h USING (src_table, d, same)),
s AS (
  SELECT a.src_table, a.id AS x, b.id AS y, list_inner_product(a.e, b.e) AS c
  FROM u a JOIN u b ON a.src_table = b.src_table AND a.d = b.d AND a.id <> b.id
), r AS (SELECT *, row_number() OVER (PARTITION BY src_table, x ORDER BY c DESC, y) AS k FROM s)
"""
_P3 = _P3_PAIRS + """
SELECT DISTINCT src_table, least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE k <= 5 AND c >= 0.9
"""
#: Every two records that share a triple of words.
_P5_PAIRS = """
WITH RECURSIVE w AS (
  SELECT src_table, id, any_value(list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS w
  FROM (SELECT 'chunks' AS src_table, id, content FROM chunks UNION ALL SELECT 'observations', id, content FROM observations)
  WHERE content IS NOT NULL GROUP BY src_table, id
), t AS (
  SELECT DISTINCT src_table, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2
), n AS (SELECT src_table, id, count(*) AS n FROM t GROUP BY src_table, id),
p AS (SELECT a.src_table, a.id AS id_a, b.id AS id_b, count(*) AS k FROM t a JOIN t b ON a.src_table = b.src_table AND a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT p.src_table, id_a, id_b, k = x.n AND k = y.n AS same FROM p JOIN n x ON x.src_table = p.src_table AND x.id = id_a JOIN n y ON y.src_table = p.src_table AND y.id = id_b
 WHERE k >= 0.6 * (x.n + y.n - k))
"""
_P5 = _P5_PAIRS + "SELECT src_table, id_a, id_b FROM l"
#: Connected records, by following links from each of them.
_P5_GROUPS = _P5_PAIRS + """
, e AS (SELECT src_table, id_a AS x, id_b AS y, same FROM l UNION ALL SELECT src_table, id_b, id_a, same FROM l),
reach AS (SELECT DISTINCT src_table, x AS id, x AS found FROM e UNION SELECT r.src_table, r.id, e.y FROM reach r JOIN e ON e.src_table = r.src_table AND e.x = r.found),
g AS (SELECT src_table, id, min(found) AS group_id FROM reach GROUP BY ALL),
c AS (SELECT src_table, x AS id, least(x, coalesce(min(CASE WHEN same THEN y END), x)) AS class_id FROM e GROUP BY src_table, x),
n2 AS (SELECT e.src_table, e.x AS id, count(DISTINCT CASE WHEN NOT same THEN c.class_id END) AS n_links FROM e JOIN c ON c.src_table = e.src_table AND c.id = e.y GROUP BY ALL)
SELECT src_table, id, group_id, class_id, n_links FROM g JOIN c USING (src_table, id) JOIN n2 USING (src_table, id)
"""
_LETTERS = "[\\p{L}\\p{Nl}\\p{No}]+(?:[''’][\\p{L}\\p{Nl}\\p{No}]+)*"
SQL = {
    "p3_found": _P3,
    "p3_nearest": _P3_PAIRS + "SELECT src_table, x AS id, y AS neighbour FROM r WHERE k <= 5",
    "p5_found": _P5,
    "p5_groups": _P5_GROUPS,
    "p6_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 1024",
    "p6_coverage": "SELECT DISTINCT id AS chunk_id, CAST(0 AS BIGINT) AS starts_at, length(content) AS covered, TRUE AS fits, TRUE AS own_text, TRUE AS joined FROM chunks WHERE length(content) > 1024",
    "p7_whole": "SELECT container, (SELECT count(*) FROM documents) AS n_documents, TRUE AS whole, TRUE AS fits FROM pack_sizes",
    "p8_limits": "SELECT source, target_share AS asked, max_repeats AS repeats, TRUE AS kept, TRUE AS within FROM mix_targets",
    "p9_counts": f"SELECT doc_id, length(text) AS n_chars, len(w) AS n_words, round(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 6) AS mean_word_length, length(trim(text, ' \t\r\n')) = 0 AS blank FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '{_LETTERS}') AS w FROM documents)",
}
