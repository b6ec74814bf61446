"""Mixing sources to target shares by weighted sampling without replacement.

Every source gets its share of the wanted number of tokens. As long as its
budget holds all of its documents they are all taken, at most ``max_repeats``
times; what remains is a fraction, filled by Efraimidis and Spirakis: each
document draws an exponential key over its quality weight, and the documents
with the smallest keys are taken while their prefix sum of tokens stays within
the budget. The weight is a document's quality: the share of it that is running sentences,
each counted once, and at least ``LEAST_WEIGHT``.

Scale: no source is sorted in one task, whatever its size. Keys fall into
``BUCKETS`` ranges for each doubling; as a key is an exponential number over a weight, a
range holds at most 0.37 ln 2 / ``BUCKETS`` of a source (0.2 %), whatever the weights are.
The ranges' token sums (a table of bounded size) are
accumulated and tell which ranges are taken whole and in which one the budget
ends; only that range is ordered, in a window of its own. What the last document
that didn't fit leaves over goes to those, ``FILLS`` at most, that fill it best, one after another. The random number of
a document is a hash of its id and the seed, so a lost task draws it again.

A target without documents, or whose repeats are used up, falls short; its
budget isn't given to others, and the report says what was reached. Cases:
sources compare without regard to case, blanks and ``-`` for ``_``; null
sources and those without a target are not taken; null and empty texts have no
tokens and are not taken; a repeated doc_id is one document; ties in keys go by doc_id; a target listed twice has
its shares added and its repeats at the larger; a null or non-positive share
asks for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import tokens as T
from lodestack.llm.quality import prose_weight
from lodestack.operators.columns import pick
from lodestack.session import spread, written

SIZE_SHARE = 0.5
BUCKETS = 128
LEAST_WEIGHT = 0.05
#: Documents a source may get to fill its budget beyond the prefix.
FILLS = 4
SEED = 20


def source_name(c):
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def sized(documents: DataFrame, vocabulary: str = T.VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, weight of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.drop(columns="text")
            out["tokens"] = [T.count(t, vocabulary) for t in b["text"]]
            out["weight"] = [prose_weight(t) for t in b["text"]]
            yield out

    rows = pick(documents, "doc_id", "source", "text").select(F.col("doc_id").cast("bigint"), "source", "text")
    return spread(rows).mapInPandas(run, "doc_id bigint, source string, tokens bigint, weight double")


def keyed(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, key: exponential of rate ``weight``."""
    unit = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return (
        sizes.where(F.col("source").isNotNull() & (F.col("tokens") > 0))
        .withColumn("weight", F.greatest("weight", F.lit(LEAST_WEIGHT)))
        .select("doc_id", source_name(F.col("source")).alias("source"), "tokens", "weight", (-F.log(unit) / F.col("weight")).alias("key"))
    )


def budgets(docs: DataFrame, targets: DataFrame, total: float) -> DataFrame:
    """One row per target: budget, whole epochs, tokens of the fraction."""
    goal = (
        pick(targets, "source", "target_share", "max_repeats").where(F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n_docs"))
    budget = F.col("target_share") * F.lit(float(total))
    whole = F.least(F.floor(F.col("budget") / F.col("have")), F.col("max_repeats"))
    return (
        goal.join(have, "source", "left").withColumn("budget", budget)
        .withColumn("epochs", F.when(F.col("have") > 0, whole).otherwise(0).cast("bigint"))
        .withColumn("fraction", F.when((F.col("have") > 0) & (F.col("epochs") < F.col("max_repeats")), F.col("budget") - F.col("epochs") * F.col("have")).otherwise(0.0))
    )


def mix(sizes: DataFrame, targets: DataFrame, total: float, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, tokens, n_uses: how often each chosen document is used."""
    docs = keyed(sizes, seed)
    plan = F.broadcast(budgets(docs, targets, total))  # a row per target
    bucket = F.floor(F.log2("key") * buckets)
    mine = docs.join(plan.select("source", "epochs", "fraction"), "source").withColumn("bucket", bucket)
    sums = mine.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(upto), F.lit(0)))
    placed = mine.join(starts, ["source", "bucket"])
    whole = placed.where(F.col("before") + F.col("in_bucket") <= F.col("fraction")).withColumn("extra", F.lit(1))
    beyond = placed.where(F.col("before") >= F.col("fraction")).withColumn("extra", F.lit(0))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.where((F.col("before") < F.col("fraction")) & (F.col("before") + F.col("in_bucket") > F.col("fraction")))
    reached = F.col("before") + F.sum("tokens").over(inside)
    split = split.withColumn("extra", (reached <= F.col("fraction")).cast("int"))
    drawn = base = written(whole.unionByName(beyond).unionByName(split), "drawn")
    # what is left of a budget goes to the document not drawn that fills it best, and what that leaves to the next
    spark, filled = sizes.sparkSession, []
    for _ in range(FILLS):
        gaps = drawn.groupBy("source").agg((F.first("fraction") - F.sum(F.col("extra") * F.col("tokens"))).alias("gap"))
        fits = drawn.where("extra = 0").join(F.broadcast(gaps), "source").where(F.col("tokens") <= F.col("gap"))
        last = fits.groupBy("source").agg(F.max_by("doc_id", F.struct("tokens", -F.col("key"), -F.col("doc_id"))).alias("last"))
        new = [tuple(r) for r in last.collect()]  # a row per source at most
        if not new:
            break
        filled += new
        mine = F.broadcast(spark.createDataFrame(filled, "source string, doc_id bigint")).withColumn("fill", F.lit(1))
        drawn = base.join(mine, ["source", "doc_id"], "left").withColumn("extra", F.greatest("extra", F.coalesce("fill", F.lit(0)))).drop("fill")
    uses = F.col("epochs") + F.col("extra")
    return drawn.select("doc_id", "source", "tokens", uses.cast("bigint").alias("n_uses")).where("n_uses > 0")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per target: share asked for and reached, repeats, what is missing."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_uses")).alias("used"), F.max("n_uses").alias("most_uses"), F.count("*").alias("n_used"))
    all_used = Window.partitionBy()
    out = plan.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    # a handful of rows: one per target
    total = F.sum("used").over(all_used)
    return out.select(
        "source", "target_share", "max_repeats", F.col("used").alias("tokens"), F.when(total > 0, F.col("used") / total).otherwise(0.0).alias("reached_share"),
        F.greatest(F.lit(0.0), F.col("budget") - F.col("used")).alias("missing_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("n_used", F.lit(0)).alias("n_documents"),
    )


class Mixture:
    """``rows``: the mix; ``report``: shares asked for and reached."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, size_share: float = SIZE_SHARE, seed: int = SEED, vocabulary: str = T.VOCABULARY):
        sizes = written(sized(documents, vocabulary).dropDuplicates(["doc_id"]), "sizes")
        if total_tokens is None:
            total_tokens = size_share * (sizes.agg(F.sum("tokens")).first()[0] or 0)
        self.rows = mix(sizes, targets, total_tokens, seed)
        self.report = shares(self.rows, budgets(keyed(sizes, seed), targets, total_tokens))
