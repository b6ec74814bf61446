"""Filling containers of fixed capacity by a grouping genetic algorithm.

A solution is a list of containers, not of items, so what crossover passes on
is whole containers: some well-filled ones of one parent are injected in the
other, and containers that share an item with them are taken apart. The items
displaced first replace one in a container whose room they, alone or in pairs, use better
(what they replace is displaced in turn, and is smaller); the rest goes by best fit to where it leaves
least room. The fitness is the mean squared fill. An epoch ends early where no solution can be better.

Scale: items are dealt by hash into instances of about ``INSTANCE`` items; an
instance is one row of arrays. Each is worked on by ``ISLANDS`` populations in
tasks of their own, and after every epoch the elite of an island migrates to
the next one (a join of bounded rows). The best island's containers stay if
they are filled to ``GOOD``; the items of the others are dealt into new, far
fewer instances, until one instance holds them all, or until a level makes them no
fewer by a fifth (items of more than half a container, say, have no partner). No instance
depends on the number of documents, and nothing is collected.

A text larger than the container is divided: full pieces fill a container each
and the rest is an item. Cases: null and empty texts have no tokens and lie in
a container of their instance; equal sizes are told apart by id and piece;
empty tables give empty results; rows of null capacity are no containers;
a repeated doc_id is packed as often as it comes.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm import tokens as T
from lodestack.operators.columns import pick
from lodestack.session import written

INSTANCE, ISLANDS, EPOCHS, POPULATION, CHILDREN = 400, 2, 2, 4, 6
#: A container that stays; and what the others hold, on average, where an epoch can end.
GOOD, FULL = 0.998, 0.999
#: A further level has to make the loose items fewer by so much.
FEWER = 0.8
#: Rows of an instance and island that one task works on, at most about.
TASK_INSTANCES = 256

Bins = list[list[int]]


def best_fit(order: list[int], size: list[int], capacity: int, bins: Bins) -> Bins:
    """Put items where they leave the least room; new containers as needed."""
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (size[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - size[i], len(bins) - 1))
        else:
            free, k = room.pop(at)
            bins[k].append(i)
            insort(room, (free - size[i], k))
    return bins


def fitness(bins: Bins, size: list[int], capacity: int) -> float:
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / len(bins) if bins else 1.0


def least_bins(size: list[int], capacity: int) -> int:
    """No solution has fewer containers."""
    return max(-(-sum(size) // capacity), sum(2 * x > capacity for x in size), int(bool(size)))


def replaced(displaced: list[int], size: list[int], capacity: int, bins: Bins) -> list[int]:
    """Let displaced items take the place of one item of a container where they, alone or two of them,
    fill it better; what is displaced then. Containers are changed in place."""
    loose = sorted(displaced, key=lambda i: (size[i], i))
    for b in bins:
        room = capacity - sum(size[i] for i in b)
        if not room or not loose:
            continue
        sizes, best = [size[i] for i in loose], (0, None, None)
        for at, i in enumerate(b):
            goal = size[i] + room
            k = bisect_right(sizes, goal) - 1
            if k >= 0 and sizes[k] - size[i] > best[0]:
                best = (sizes[k] - size[i], at, (k,))
            if best[0] == room:
                break
            lo, hi = 0, len(sizes) - 1
            while lo < hi:  # the two that come nearest to the goal
                both = sizes[lo] + sizes[hi]
                if both > goal:
                    hi -= 1
                else:
                    if both - size[i] > best[0]:
                        best = (both - size[i], at, (lo, hi))
                    lo += 1
        gain, at, gifts = best
        if gain:
            out = b[at]
            b[at : at + 1] = [loose[k] for k in gifts]
            for k in sorted(gifts, reverse=True):
                del loose[k]
            insort(loose, out, key=lambda i: (size[i], i))
    return loose


def crossover(one: Bins, two: Bins, size: list[int], capacity: int, r: random.Random) -> Bins:
    """Some well-filled containers of ``two`` injected whole in ``one``."""
    ranked = sorted(two, key=lambda b: -sum(size[i] for i in b))
    top = ranked[: max(1, len(ranked) // 2)]
    gift = r.sample(top, max(1, len(top) // 2))
    given = {i for b in gift for i in b}
    kept, displaced = [], []
    for b in one:
        if given.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced.extend(i for i in b if i not in given)
    # mutation: the emptiest container that stayed is taken apart
    if len(kept) > 1:
        worst = min(range(len(kept)), key=lambda k: sum(size[i] for i in kept[k]))
        displaced.extend(kept.pop(worst))
    bins = [list(b) for b in gift] + kept
    displaced = replaced(displaced, size, capacity, bins)
    displaced.sort(key=lambda i: (-size[i], i))
    return best_fit(displaced, size, capacity, bins)


def evolve(size: list[int], capacity: int, seeds: list[Bins], population: int, children: int, seed: int) -> Bins:
    """One epoch of one island; ``seeds`` are its elite and the one that migrated."""
    r = random.Random(seed)
    least = least_bins(size, capacity)

    def perfect(bins: Bins) -> bool:
        """As few as can be, and nearly all that is left over is in one of them."""
        return len(bins) == least and sum(size) - min((sum(size[i] for i in b) for b in bins), default=0) >= FULL * (least - 1) * capacity

    down = sorted(range(len(size)), key=lambda i: (-size[i], i))
    people = [s for s in seeds if s]
    while len(people) < population:
        order = down if not people else sorted(down, key=lambda i: -size[i] * r.uniform(0.8, 1.0))
        people.append(best_fit(order, size, capacity, []))
        if perfect(people[-1]):
            return max(people, key=lambda p: fitness(p, size, capacity))
    scored = sorted(((fitness(p, size, capacity), n, p) for n, p in enumerate(people)), key=lambda x: (-x[0], x[1]))
    for c in range(children):
        if perfect(scored[0][2]):
            break
        a, b = r.sample(scored[: max(2, population - 1)], 2) if len(scored) > 1 else (scored[0], scored[0])
        child = crossover(a[2], b[2], size, capacity, r)
        scored.append((fitness(child, size, capacity), population + c, child))
        scored.sort(key=lambda x: (-x[0], x[1]))
        scored.pop()
    return scored[0][2]


STATE = "container string, capacity bigint, instance bigint, island int, ids array<bigint>, pieces array<int>, sizes array<bigint>, elite array<int>, score double"


def _labels(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(labels) -> Bins:
    if labels is None or not len(labels):
        return []
    out: Bins = [[] for _ in range(max(labels) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return [b for b in out if b]


def _epoch(number: int, population: int, children: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                size = [int(x) for x in r.sizes]
                seeds = [_bins([int(k) for k in e]) for e in (r.elite, r.migrant) if e is not None]
                best = evolve(size, int(r.capacity), seeds, population, children, int(r.instance) * 1009 + int(r.island) * 97 + number)
                rows.append((r.container, r.capacity, r.instance, r.island, r.ids, r.pieces, r.sizes, _labels(best, len(size)), fitness(best, size, int(r.capacity))))
            yield pd.DataFrame(rows, columns=["container", "capacity", "instance", "island", "ids", "pieces", "sizes", "elite", "score"])

    return run


ITEM = "container string, capacity bigint, doc_id bigint, piece_no int, tokens bigint"


def items(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Items of each kind of container: whole texts, and pieces of those that are larger."""
    kinds = F.broadcast(pick(containers, "container", "capacity_tokens").where(F.col("capacity_tokens") > 0).select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct())
    # a fixed small table meets every document: one row per document and kind is the result asked for
    each = sizes.select("doc_id", F.col("tokens").alias("total")).join(kinds, F.lit(True))
    n_pieces = F.greatest(F.ceil(F.col("total") / F.col("capacity")), F.lit(1))
    cut = each.select("container", "capacity", "doc_id", "total", F.posexplode(F.sequence(F.lit(1).cast("bigint"), n_pieces)).alias("pos", "k"))
    return cut.select("container", "capacity", "doc_id", F.col("k").cast("int").alias("piece_no"), F.least(F.col("capacity"), F.col("total") - (F.col("k") - 1) * F.col("capacity")).alias("tokens"))


def _solve(loose: DataFrame, level: int, n_loose: int, size: int, islands: int, epochs: int, population: int, children: int) -> DataFrame:
    """The best solution of each instance, one row per item with its container's fill."""
    # few small rows, much work each: without a number they would be put together in a few tasks
    parts = max(2 * loose.sparkSession.sparkContext.defaultParallelism, -(-n_loose * islands // size // TASK_INSTANCES))
    counts = loose.groupBy("container").agg(F.count("*").alias("n"))
    # the row's place tells copies of one id apart, which would else all meet in one instance;
    # it is the same for a task that runs again, as what is read here lies written
    numbered = loose.withColumn("place", F.monotonically_increasing_id())
    dealt = numbered.join(F.broadcast(counts), "container").withColumn(
        "instance", F.pmod(F.xxhash64("doc_id", "piece_no", "place", F.lit(level)), F.greatest(F.ceil(F.col("n") / size), F.lit(1)))
    )
    rows = dealt.groupBy("container", "capacity", "instance").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece_no", "tokens"))).alias("x"))
    state = rows.select(
        "container", "capacity", "instance", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.doc_id").alias("ids"), F.col("x.piece_no").alias("pieces"),
        F.col("x.tokens").alias("sizes"), F.lit(None).cast("array<int>").alias("elite"), F.lit(0.0).alias("score"),
    )
    for e in range(epochs):
        if e:
            moved = state.select("container", "instance", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("migrant"))
            state = state.join(moved, ["container", "instance", "island"])
        else:
            state = state.withColumn("migrant", F.lit(None).cast("array<int>"))
        state = written(state.repartition(parts, "container", "instance", "island").mapInPandas(_epoch(e, population, children), STATE), "islands")
    best = state.groupBy("container", "capacity", "instance").agg(F.max_by(F.struct("ids", "pieces", "sizes", "elite"), F.struct("score", -F.col("island"))).alias("b"))
    flat = best.select("container", "capacity", "instance", F.inline(F.arrays_zip(F.col("b.ids").alias("doc_id"), F.col("b.pieces").alias("piece_no"), F.col("b.sizes").alias("tokens"), F.col("b.elite").alias("k"))))
    bins = flat.groupBy("container", "instance", "k").agg(F.sum("tokens").alias("filled"))
    return flat.join(bins, ["container", "instance", "k"]).withColumn("bin", F.concat_ws("-", F.lit(level), "instance", "k"))


OUT = ["container", "bin", "doc_id", "piece_no", "tokens"]


def pack(sizes: DataFrame, containers: DataFrame, instance: int = INSTANCE, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, children: int = CHILDREN, good: float = GOOD) -> DataFrame:
    """container, bin, doc_id, piece_no, tokens: every text in one container of each kind, or in pieces if it is larger."""
    loose = items(sizes, containers)
    full = F.col("tokens") == F.col("capacity")
    done = [loose.where(full).select("container", F.concat_ws("-", F.lit("full"), F.monotonically_increasing_id()).alias("bin"), "doc_id", "piece_no", "tokens")]
    loose = loose.where(~full)
    level, before = 0, {r["container"]: r["n"] for r in loose.groupBy("container").agg(F.count("*").alias("n")).collect()}
    while before:
        solved = written(_solve(loose, level, sum(before.values()), instance, islands, epochs, population, children), "packed")
        low = {r["container"]: r["low"] for r in solved.groupBy("container").agg(F.sum(F.when(F.col("filled") < good * F.col("capacity"), 1).otherwise(0)).alias("low")).collect()}
        ends = [c for c, n in before.items() if n <= instance or low[c] > FEWER * n or low[c] == 0]
        over = F.col("container").isin(ends) | (F.col("filled") >= good * F.col("capacity"))
        done.append(solved.where(over).select(*OUT))
        loose = solved.where(~over).select("container", "capacity", "doc_id", "piece_no", "tokens")
        level, before = level + 1, {c: low[c] for c in before if c not in ends}
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """How full the containers of each kind are, and the least number any packing needs by size alone."""
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("filled"), F.count("*").alias("n_items"))
    each = bins.groupBy("container").agg(F.count("*").alias("n_bins"), F.sum("filled").alias("tokens"), F.sum("n_items").alias("n_items"), F.max("filled").alias("fullest"))
    return each.join(containers.select("container", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct(), "container").select(
        "container", "capacity", "n_items", "n_bins", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), "fullest", (F.col("tokens") / (F.col("n_bins") * F.col("capacity"))).alias("fill")
    )


def pack_documents(documents: DataFrame, containers: DataFrame, vocabulary: str = T.VOCABULARY) -> DataFrame:
    return pack(written(T.sizes(documents, path=vocabulary), "sizes"), containers)
