"""Near-duplicate records with small edits.

A record is the set of its triples of consecutive words. Its fingerprint has
``SLOTS`` minimum-hash slots of 16 bits, and the share of equal slots is that of
common triples. A bit of each slot makes its *code*. The index over
fingerprints is a hierarchy of masked bit patterns:

* *upper nodes*: each of ``BANDS`` masks leaves the 48 bits of three slots of a
  fingerprint; records whose bits under a mask are equal share an upper node.
  A pair at the threshold 0.6 shares none of 32 nodes with probability 4e-4,
  at 0.7 with 1.5e-6, at 0.8 with 1e-10.
* *lower nodes*: an upper node's records lie in Gray order of their codes, so
  that close ones are often neighbours. Neighbours that share ``SHARED`` bits form
  a node that knows those bits (a mask and a pattern), neighbours among these the
  nodes above, and so on.
* two nodes are compared from the top: where both have a bit shared and it
  differs, it differs in all pairs below. These differences add up on the way down,
  each bit counted at the level where it becomes shared, and a pair of
  nodes is dropped with all its records once more than ``MAX_DIFF`` have.

``MAX_DIFF`` lies four standard deviations above what a pair at the threshold
differs in. What remains is checked exactly on the sets of triples.

Scale: equal sets are one class before the index is built, so copies that hold
a third of all rows are one entry. Rows of the index are two numbers until it is
known which nodes have several records; those get their codes then. Masked patterns
that very many records share are told from a sample (which changes no result): their
rows skip the count of a node's records and are spread by Gray rank. Nodes over ``BLOCK`` records are cut in
blocks; the shared bits of blocks meet first, and only pairs of blocks that may hold
a close pair are brought together, spread over tasks. Nothing is collected.

Cases: null contents and texts of fewer than three words have no triples and
no partner; a repeated id is one record; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.columns import pick
from lodestack.session import discard, spread, written

THRESHOLD, WORDS = 0.6, 3
SLOTS, ROWS, BANDS = 192, 3, 32
MAX_DIFF = 60
#: Bits that the records of a lower node share; records of a node that are compared side by side; of a block.
SHARED, FEW, BLOCK = 150, 8, 1024
#: A masked pattern is spread from so many records on, or this share of all rows, whichever is more;
#: so at most as many patterns are as this share goes into all, give or take what a sample errs.
SPREAD_ROWS, SPREAD_SHARE = 16_384, 1e-4
SAMPLED = 64

_WORD = re.compile(rb"[a-z0-9_]+")
_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_MUL, _ADD = _odd(11, SLOTS), _odd(12, SLOTS)
_PART = _odd(13, 8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``words`` consecutive words."""
    found = _WORD.findall(text.encode("utf-8", "replace").lower()) if text else []
    n = len(found) - words + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h += w[k : k + n] * _PART[k]
    return np.unique(_mix(h))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum-hash slots of each (non-empty) set."""
    out = np.empty((len(sets), SLOTS), np.uint64)
    for i, s in enumerate(sets):
        low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 4096):  # a long text stays small in memory
            low = np.minimum(low, ((s[at : at + 4096, None] + _ADD) * _MUL).min(0))
        out[i] = low
    return _mix(out)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Rank of bit patterns (a column a word, highest first) in Gray order."""
    rank = bits.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(s)
    for k in range(1, rank.shape[1]):
        rank[:, k] ^= np.where(rank[:, k - 1] & _U(1), ~_U(0), _U(0))
    return rank


def gray_code(rank: np.ndarray) -> np.ndarray:
    code = rank ^ (rank >> _U(1))
    code[:, 1:] ^= rank[:, :-1] << _U(63)
    return code


def _code(slots: np.ndarray) -> np.ndarray:
    """A bit of each slot, in words of 64."""
    return np.packbits((slots & 1).astype(np.uint8), axis=1).view(">u8").astype(np.uint64)


def masked(slots: np.ndarray, rows: int, bands: int, tag: np.ndarray) -> np.ndarray:
    """The bits of the slots under each mask, with the mask's number and a tag of the table above them."""
    out = np.empty((len(slots), bands), np.uint64)
    for k in range(bands):
        bits = tag << _U(6) | _U(k)
        for j in range(rows):
            bits = bits << _U(16) | slots[:, k * rows + j].astype(np.uint64)
        out[:, k] = bits
    return out


RANKS = [f"rank_{k}" for k in range(SLOTS // 64)]
SIGNATURE = "src_table string, id string, set_hash binary, set_key bigint, " + ", ".join(f"{r} bigint" for r in RANKS) + ", masks array<bigint>"


def _signature_rows(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src_table", pa.string()), ("id", pa.string()), ("set_hash", pa.binary()), ("set_key", pa.int64()), *((r, pa.int64()) for r in RANKS), ("masks", pa.list_(pa.int64()))])
        for b in batches:
            src, ids = b.column("src_table").to_pylist(), b.column("id").to_pylist()
            kept, sets = [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                s = shingles(text, words)
                if len(s) and ids[i] is not None:
                    kept.append(i)
                    sets.append(s)
            if not kept:
                continue
            slots = (minima(sets) & _U(0xFFFF)).astype(np.uint16)
            rank = gray_rank(_code(slots)).view(np.int64)
            table = np.array([xxhash.xxh3_64_intdigest(src[i] or "") for i in kept], np.uint64)
            masks = masked(slots, rows, bands, table & _U(0x3FF))
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            keys = (np.frombuffer(b"".join(hashes), np.uint64)[::2] ^ table).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([src[i] for i in kept]), pa.array([ids[i] for i in kept]), pa.array(hashes, pa.binary()), pa.array(keys), *(pa.array(rank[:, k]) for k in range(rank.shape[1])),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * bands + 1, bands, dtype=np.int32)), pa.array(masks.view(np.int64).ravel()))],
                schema=schema,
            )

    return run


def signatures(rows: DataFrame, words: int = WORDS, per_mask: int = ROWS, masks: int = BANDS) -> DataFrame:
    """src_table, id, content -> fingerprints of every record that has triples."""
    return spread(rows.select("src_table", "id", "content")).mapInArrow(_signature_rows(words, per_mask, masks), SIGNATURE)


def _codes(ranks: np.ndarray) -> np.ndarray:
    return gray_code(np.ascontiguousarray(ranks).view(np.uint64))


def _close(code_a: np.ndarray, code_b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(code_a ^ code_b).sum(-1, dtype=np.int64) <= most


class Nodes:
    """The hierarchy over codes in Gray order. A level holds, of each node, the bits that are
    shared by all of its records (``mask``), their values (``pattern``) and where its one or two
    children in the level below start; level 0 are the records. Neighbours
    become one node as long as they share ``SHARED`` bits, others go up as they are."""

    def __init__(self, code: np.ndarray):
        self.levels = [(np.full_like(code, ~_U(0)), code, np.arange(len(code) + 1))]
        idle = 0
        while idle < 2 and len(self.levels[-1][0]) > 1:  # pairs that start at even places, then at odd ones
            mask, pattern, _ = self.levels[-1]
            n, odd = len(mask), len(self.levels) % 2 == 0
            at = np.arange(int(odd), n - 1, 2)
            both = mask[at] & mask[at + 1] & ~(pattern[at] ^ pattern[at + 1])
            fit = at[np.bitwise_count(both).sum(1) >= SHARED]
            idle = 0 if len(fit) else idle + 1
            second = np.zeros(n, bool)
            second[fit + 1] = True
            starts = np.flatnonzero(~second)
            new = mask[starts].copy()
            new[np.isin(starts, fit)] = both[np.isin(at, fit)]
            self.levels.append((new, pattern[starts] & new, np.r_[starts, n]))


def close_pairs(one: Nodes, two: Nodes, most: int, tally: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of records of ``one`` and ``two`` whose codes differ in at most ``most`` bits; each pair
    once where both are the same. ``tally`` counts pairs of nodes met and dropped, and of records compared."""
    same = one is two
    la, lb = len(one.levels) - 1, len(two.levels) - 1
    na, nb = len(one.levels[la][0]), len(two.levels[lb][0])
    a, b = np.divmod(np.arange(na * nb), nb)
    if same:
        a, b = a[a <= b], b[a <= b]
    apart = np.zeros(len(a), np.int64)
    known = np.zeros((len(a), one.levels[0][0].shape[1]), np.uint64)  # bits whose differences are in the sum
    while True:
        (ma, pa_, starts_a), (mb, pb, starts_b) = one.levels[la], two.levels[lb]
        shared = ma[a] & mb[b]
        apart += np.bitwise_count((pa_[a] ^ pb[b]) & shared & ~known).sum(1, dtype=np.int64)
        keep = apart <= most
        if tally is not None:
            tally["records" if la == lb == 0 else "nodes"] += len(a)
            tally["dropped"] += 0 if la == lb == 0 else int((~keep).sum())
        a, b, apart, known = a[keep], b[keep], apart[keep], shared[keep]
        if la == lb == 0:
            off = a < b if same else np.ones(len(a), bool)
            return a[off], b[off]
        down_a, down_b = la >= lb, lb >= la  # the deeper hierarchy goes down first
        first_a, last_a = (starts_a[a], starts_a[a + 1] - 1) if down_a else (a, a)
        first_b, last_b = (starts_b[b], starts_b[b + 1] - 1) if down_b else (b, b)
        la, lb = la - down_a, lb - down_b
        parts = []
        for x, y, fit in ((first_a, first_b, None), (first_a, last_b, last_b > first_b), (last_a, first_b, last_a > first_a), (last_a, last_b, (last_a > first_a) & (last_b > first_b))):
            at = np.arange(len(x)) if fit is None else np.flatnonzero(fit)
            at = at[x[at] <= y[at]] if same else at
            parts.append((x[at], y[at], apart[at], known[at]))
        a, b, apart, known = (np.concatenate(x) for x in zip(*parts))


#: a, b: a pair of close fingerprints; or a block: its upper node, members and shared bits.
NODE = "a bigint, b bigint, mask bigint, block binary, members binary, shared binary, pattern binary"
_NODE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64()), ("block", pa.binary()), ("members", pa.binary()), ("shared", pa.binary()), ("pattern", pa.binary())])


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    none = [pa.nulls(len(pairs), f.type) for f in list(_NODE)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *none], schema=_NODE)


def _block_row(mask: int, key: np.ndarray, ranks: np.ndarray) -> tuple:
    code = _codes(ranks)
    packed = np.concatenate([key[:, None].view(np.uint64), code], 1)
    all_set, any_set = np.bitwise_and.reduce(code), np.bitwise_or.reduce(code)
    # a block is named by its first record, so that blocks of several tasks have different names
    return None, None, mask, np.ascontiguousarray(np.r_[ranks[0], key[0]]).tobytes(), packed.tobytes(), (all_set | ~any_set).tobytes(), all_set.tobytes()


def _walk_nodes(most: int, block: int):
    """Rows come sorted by upper node, part and Gray rank. Nodes of up to ``block``
    records that lie here whole give their close pairs, others are cut in blocks."""

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        """Of whole nodes: small ones side by side, the others through their hierarchy."""
        node, key, code = rows[:, 0], rows[:, 2], _codes(rows[:, 3:])
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(rows)])
        out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        few = np.repeat(sizes <= FEW, sizes)
        for lag in range(1, FEW):
            at = np.flatnonzero(few[lag:] & (node[lag:] == node[:-lag]))
            if not len(at):
                break
            at = at[_close(code[at], code[at + lag], most)]
            out_a.append(key[at])
            out_b.append(key[at + lag])
        for at, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
            nodes = Nodes(code[at : at + n])
            i, j = close_pairs(nodes, nodes, most)
            out_a.append(key[at + i])
            out_b.append(key[at + j])
        return _pair_rows(np.concatenate(out_a), np.concatenate(out_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 3 + len(RANKS)
        rest = np.empty((0, width), np.int64)
        cut: int | None = None  # the large node that is open

        def split(rows: np.ndarray, last: bool):
            nonlocal rest, cut
            blocks, rest = [], rows[:0]
            while len(rows):
                node = rows[:, 0]
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                ends = np.r_[starts[1:], len(rows)]
                # spread ones (a part other than 0) and those that are too large
                large = np.flatnonzero((ends - starts > block) | (rows[starts, 1] != 0) | (node[starts] == cut if cut is not None else False))
                whole = starts[large[0]] if len(large) else (len(rows) if last else starts[-1])
                if whole:
                    yield pairs(rows[:whole])
                    rows = rows[whole:]
                    cut = None
                if not len(large):
                    rest = rows
                    break
                own = rows[: ends[large[0]] - whole]
                rows = rows[len(own) :]
                cut = int(own[0, 0])
                ended = last or len(rows) > 0
                while len(own) >= block or (ended and len(own)):
                    blocks.append(_block_row(cut, own[:block, 2].copy(), own[:block, 3:]))
                    own = own[block:]
                if ended:
                    cut = None
                else:
                    rest = own
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks), _NODE)], schema=_NODE)

        for b in batches:
            new = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(width)], 1)
            yield from split(np.concatenate([rest, new]), False)
        yield from split(rest, True)

    return run


def _block_pairs(most: int, words: int):
    """Close pairs of two blocks, through their hierarchies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(b.column("members").to_pylist(), b.column("others").to_pylist()):
                x = np.frombuffer(one, np.uint64).reshape(-1, words + 1)
                y = x if one == two else np.frombuffer(two, np.uint64).reshape(-1, words + 1)
                nodes = Nodes(np.ascontiguousarray(x[:, 1:]))
                i, j = close_pairs(nodes, nodes if y is x else Nodes(np.ascontiguousarray(y[:, 1:])), most)
                rows = _pair_rows(x[i, 0].view(np.int64), y[j, 0].view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"])

    return run


def _apart(most: int):
    """Pairs of blocks whose shared bits don't differ too often already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sx, px, sy, py = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("shared_x", "pattern_x", "shared_y", "pattern_y"))
            least = np.bitwise_count((px ^ py) & sx & sy).sum(1, dtype=np.int64)
            keep = pa.array(least <= most)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("mask", "block", "block_y")], names=["mask", "block", "block_y"])

    return run


def _wide_masks(reps: DataFrame, least_rows: int) -> DataFrame:
    """Masked patterns that very many records share (mask, parts), from the records whose key a
    number divides; at most about one in ``SPREAD_SHARE`` of all rows can be that frequent."""
    drawn = reps.where(F.pmod(F.xxhash64("set_key"), F.lit(SAMPLED)) == 0).select(F.explode("masks").alias("mask"))
    total = drawn.agg(F.count("*").alias("total"))
    n = drawn.groupBy("mask").agg((F.count("*") * SAMPLED).alias("n"))
    return n.join(F.broadcast(total), F.lit(True)).where(F.col("n") >= F.greatest(F.lit(least_rows), F.col("total") * SAMPLED * SPREAD_SHARE)).select("mask", F.ceil(F.col("n") / least_rows * 4).cast("bigint").alias("parts"))


def candidates(reps: DataFrame, most: int = MAX_DIFF, block: int = BLOCK, spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """a, b: keys of sets whose fingerprints share a masked pattern and differ in at most ``most`` bits."""
    wide = written(_wide_masks(reps, spread_rows), "wide-masks")
    rows = reps.select(F.explode("masks").alias("mask"), "set_key").join(F.broadcast(wide), "mask", "left")
    several = Window.partitionBy("mask")
    counted = rows.where("parts is null").withColumn("n", F.count("*").over(several)).where("n > 1").drop("n")
    shared = counted.unionByName(rows.where("parts is not null")).join(reps.select("set_key", *RANKS), "set_key")
    # of a spread pattern each range of Gray ranks is a part of its own, numbered from 1
    top = F.shiftrightunsigned(RANKS[0], 33)
    part = F.coalesce(1 + F.floor(top * F.col("parts") / (1 << 31)), F.lit(0)).cast("bigint")
    nodes = shared.select("mask", part.alias("part"), "set_key", *RANKS).repartition("mask", "part")
    walked = written(nodes.sortWithinPartitions("mask", "part", *RANKS).mapInArrow(_walk_nodes(most, block), NODE), "nodes")
    blocks = walked.where("mask is not null")
    one = blocks.select("mask", "block", F.col("shared").alias("shared_x"), F.col("pattern").alias("pattern_x"))
    two = blocks.select("mask", F.col("block").alias("block_y"), F.col("shared").alias("shared_y"), F.col("pattern").alias("pattern_y"))
    # shared bits meet first, records only where they may be close
    met = one.join(two, "mask").where("block <= block_y").mapInArrow(_apart(most), "mask bigint, block binary, block_y binary")
    large = (
        met.join(blocks.select("mask", "block", "members"), ["mask", "block"])
        .join(blocks.select("mask", F.col("block").alias("block_y"), F.col("members").alias("others")), ["mask", "block_y"])
        .select("members", "others").mapInArrow(_block_pairs(most, len(RANKS)), "a bigint, b bigint")
    )
    return walked.where("a is not null").select("a", "b").unionByName(large).distinct()


VERIFIED = "src_table string, hash_a binary, hash_b binary, jaccard double"


def _verify(words: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, last = [], (None, None)
            for r in b.itertuples(index=False):
                if last[0] != r.hash_a:
                    last = r.hash_a, shingles(r.text_a, words)
                one, two = last[1], shingles(r.text_b, words)
                both = len(np.intersect1d(one, two, assume_unique=True))
                either = len(one) + len(two) - both
                if either and both >= least * either:
                    out.append((r.src_table, r.hash_a, r.hash_b, both / either))
            yield pd.DataFrame(out, columns=["src_table", "hash_a", "hash_b", "jaccard"])

    return run


class NearDuplicates:
    """Classes of equal sets (``members``) and links between different ones (``links``)."""

    def __init__(self, rows: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, per_mask: int = ROWS, masks: int = BANDS, most: int = MAX_DIFF):
        rows = pick(rows, "src_table", "id", "content")
        sig = written(signatures(rows, words, per_mask, masks), "fingerprints")
        self.members = sig.select("src_table", "set_hash", "id").distinct()
        reps = sig.groupBy("src_table", "set_hash").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("set_key", *RANKS, "masks")))
        reps = written(reps, "classes")
        pairs = candidates(reps, most)
        # the texts of the sets that stand in a pair, once each
        keys = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        at = reps.select("src_table", "set_hash", "set_key", "rep").join(keys, "set_key")
        texts = (
            rows.withColumnRenamed("id", "rep").join(at, ["src_table", "rep"])
            .groupBy("src_table", "set_hash", "set_key").agg(F.first("content").alias("text"))
        )
        a = texts.select(F.col("src_table"), F.col("set_key").alias("a"), F.col("set_hash").alias("hash_a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("src_table").alias("src_b"), F.col("set_key").alias("b"), F.col("set_hash").alias("hash_b"), F.col("text").alias("text_b"))
        self.links = written(
            pairs.join(a, "a").join(b, "b").where("src_table = src_b")
            .select("src_table", "hash_a", "text_a", "hash_b", "text_b").mapInPandas(_verify(words, threshold), VERIFIED),
            "links",
        )

    def pairs(self) -> DataFrame:
        """Every pair of ids, copies included: src_table, id_a, id_b."""
        one = self.members.select("src_table", F.col("set_hash").alias("hash_a"), F.col("id").alias("x"))
        two = self.members.select("src_table", F.col("set_hash").alias("hash_b"), F.col("id").alias("y"))
        same = one.join(two, (one.src_table == two.src_table) & (one.hash_a == two.hash_b) & (F.col("x") < F.col("y"))).select(one.src_table, "x", "y")
        apart = self.links.join(one, ["src_table", "hash_a"]).join(two, ["src_table", "hash_b"]).select("src_table", "x", "y")
        return same.unionByName(apart).select("src_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """src_table, id, group_id (smallest id of the connected records), class_id (smallest id of
        the records with the same triples), n_links (to classes with other triples)."""
        ends = self.links.select("src_table", F.inline(F.array(F.struct(F.col("hash_a").alias("u"), F.col("hash_b").alias("v")), F.struct(F.col("hash_b").alias("u"), F.col("hash_a").alias("v")))))
        # connected components: minimum labels of neighbours, and of labels' labels, which halves paths each round
        labels = written(ends.groupBy("src_table", "u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
        while True:
            near = ends.join(labels.withColumnRenamed("u", "v"), ["src_table", "v"]).groupBy("src_table", "u").agg(F.min("label").alias("near"))
            jump = labels.join(labels.select("src_table", F.col("u").alias("label"), F.col("label").alias("over")), ["src_table", "label"], "left")
            new = jump.join(near, ["src_table", "u"]).select("src_table", "u", F.least("label", F.coalesce("over", "label"), "near").alias("label"), F.col("label").alias("old"))
            new = written(new, "labels")
            settled = new.where("label <> old").isEmpty()
            discard(labels)
            labels = new.drop("old")
            if settled:
                break
        links = ends.groupBy("src_table", F.col("u").alias("set_hash")).agg(F.count("*").alias("n_links"))
        sets = self.members.groupBy("src_table", "set_hash").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
        full = sets.join(labels.withColumnRenamed("u", "set_hash"), ["src_table", "set_hash"], "left").join(links, ["src_table", "set_hash"], "left")
        full = full.withColumn("label", F.coalesce("label", "set_hash"))
        names = full.groupBy("src_table", "label").agg(F.min("class_id").alias("group_id"), F.sum("n").alias("size")).where("size > 1")
        classes = full.join(names, ["src_table", "label"]).select("src_table", "set_hash", "group_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.members.join(classes, ["src_table", "set_hash"]).select("src_table", "id", "group_id", "class_id", "n_links")
