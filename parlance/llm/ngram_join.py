"""Operator 4, the n-gram Jaccard join over count vectors.

A document is the set of its 5-word shingles. The shingles are hashed into
groups, about as many as the set is large; how many fall into each group
makes a point, and the sum over the groups of the smaller count bounds what
two sets can share. Points are kept in R-trees whose boxes give the same
bound for all points inside, and only pairs that the bound lets through are
verified on the sets themselves.

An R-tree holds the documents that share one *cell*: a shingle among the
first ``n - ceil(0.75 n) + 1`` of both in one order of all shingles. Two
sets that link share such a shingle for any order, so no link is lost; the
order takes frequent shingles last, so that cells stay small. Links are
needed only between documents that are not joined yet, so each document is
first verified against one document of its cells, and the trees are then
searched for pairs between different components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from .bytewords import mix, shingles, words_of
from .common import Scratch, release_memory, shuffle_partitions, table
from .components import connected_components
from .tokens import byte_slices

SIZE = 5
# A set of n shingles has FINE times the largest power of two of groups up
# to n, of which a tree takes FINE together; this many at least. A count is
# a byte.
FINE, LEAST_GROUPS, MOST_COUNT = 4, 64, 255
# A group of documents that has more surviving pairs than this for each of
# them sends the best of them first, enough to join all that may be joined.
MANY_PAIRS = 4
# Frequencies are counted by hash prefix in a table of this many bits,
# whatever the input, and kept as half octaves. They only order shingles.
COUNT_BITS, BLOCK = 22, 4096
# Cells of shingles counted this often are dealt out in parts.
LARGE_CELL = 4096
# More documents of one cell and size band than this are dealt out as pairs
# of tiles; a node of the tree holds FANOUT entries. A task thins out its
# pairs when it holds HELD_PAIRS.
TILE, HELD_PAIRS = 4000, 1 << 20
FANOUT = 16
# Sizes of sets that link differ by a factor of 4/3 at most.
BAND = 1.34


def required(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Seven times the least overlap of linked sets of sizes a and b:
    100 o >= 75 (a + b - o)."""
    return 3 * (a + b)


# -- features -----------------------------------------------------------------

def sets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where
    each text's begin."""
    hashes, first = shingles(words_of(texts), SIZE)
    own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in own], out=begin[1:])
    return np.concatenate([*own, np.zeros(0, np.uint64)]), begin


def set_ids(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0x5BD1E995)), dtype=np.uint64)))
    return mix(sums[begin[1:]] - sums[begin[:-1]] + np.diff(begin).astype(np.uint64)).view(np.int64)


def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of a task fall under each hash prefix, in blocks."""
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for batch in batches:
        for part in byte_slices(batch.column(0)):
            at = shingles(words_of(part), SIZE)[0] >> np.uint64(64 - COUNT_BITS)
            total += np.bincount(at.astype(np.int64), minlength=len(total))
    rows = total.astype("<i4").reshape(-1, BLOCK)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([rows[k].tobytes() for k in used], pa.binary())], ["block", "counts"])


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of all tasks, as half octaves."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(counts.as_buffer(), "<i4")
            total[block] = total.get(block, 0) + own.astype(np.int64)
    levels = [half_octaves(v).astype(np.uint8).tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])


def half_octaves(count):
    return np.floor(2 * np.log2(np.asarray(count) + 1))


def frequency_levels(texts: DataFrame, partitions: int) -> np.ndarray:
    """The half octave of the count of each hash prefix over all texts:
    ``2**COUNT_BITS`` bytes, whatever the input."""
    blocks = texts.mapInArrow(count_blocks, "block int, counts binary").repartition(partitions, "block")
    out = np.zeros((1 << COUNT_BITS) // BLOCK * BLOCK, np.uint8).reshape(-1, BLOCK)
    for block, levels in blocks.mapInArrow(add_blocks, "block int, levels binary").collect():
        out[block] = np.frombuffer(bytes(levels), np.uint8)
    return out.ravel()


def level_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[hashes >> np.uint64(64 - COUNT_BITS)]


def groups_for(n: np.ndarray) -> np.ndarray:
    """How many groups sets of ``n`` shingles have."""
    octave = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    return np.maximum(LEAST_GROUPS, FINE << octave.astype(np.int64))


def group_counts(flat: np.ndarray, begin: np.ndarray) -> list[bytes | None]:
    """Count vector of each set: two bits a group, and a byte for each that
    counts three or more, in order. Empty where a count is over a byte, which
    lets every pair of that set through to verification."""
    out: list[bytes | None] = []
    for a, b, size in zip(begin[:-1], begin[1:], groups_for(np.diff(begin)).tolist()):
        own = np.bincount((flat[a:b] & np.uint64(size - 1)).astype(np.int64), minlength=size)
        four = np.minimum(own, 3).astype(np.uint8).reshape(-1, 4)
        out.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()
                   + own[own >= 3].astype(np.uint8).tobytes() if own.max() <= MOST_COUNT else b"")
    return out


def points_of(counts: list[bytes], n: np.ndarray) -> np.ndarray:
    """Count vectors as rows of one matrix, folded to the fewest groups
    among them (the bound of folded vectors holds, too)."""
    sizes = np.where([len(c) > 0 for c in counts], groups_for(np.asarray(n)), 0)
    width = max(1, int(sizes[sizes > 0].min(initial=1 << 30))) if (sizes > 0).any() else 1
    out = np.empty((len(counts), width), np.int32)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        if size == 0:
            out[own] = n[own][:, None]  # as if all of the set were in each group
        else:
            four = np.frombuffer(b"".join([counts[i][:size // 4] for i in own]), np.uint8).reshape(len(own), -1, 1)
            rows = (four >> np.array([0, 2, 4, 6], np.uint8) & np.uint8(3)).reshape(len(own), size)
            rows[rows == 3] = np.frombuffer(b"".join([counts[i][size // 4:] for i in own]), np.uint8)
            out[own] = rows.reshape(len(own), size // width, width).sum(axis=1, dtype=np.int32)
    return out


def features_schema(id_type: str) -> str:
    return f"_id {id_type}, n bigint, sid bigint, counts binary, n_small int, prefix array<bigint>"


def make_features(levels, large: float):
    """Per text: size and name of its set; and, unless the task has met the
    same set before, its count vector and its first shingles, of which
    ``n_small`` come before those of large cells (level ``large``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            at = 0
            for part in byte_slices(batch.column(1)):
                yield one(batch.column(0).slice(at, len(part)), part, met)
                at += len(part)
        release_memory()

    def one(ids: pa.Array, part: list[bytes], met: set[int]) -> pa.RecordBatch:
        flat, begin = sets_of(part)
        n = np.diff(begin)
        names = set_ids(flat, begin)
        fresh = np.array([size > 0 and name not in met and not met.add(name)
                          for name, size in zip(names.tolist(), n.tolist())], bool)
        owner = np.repeat(np.arange(len(part)), n)
        level = level_of(flat, levels.value)
        order = flat[np.lexsort((flat, level, owner))]
        small = np.bincount(owner[level < large], minlength=len(part)).astype(np.int32)
        length = np.where(fresh, n - (3 * n + 3) // 4 + 1, 0)
        first = np.zeros(len(part) + 1, np.int32)
        np.cumsum(length, out=first[1:])
        take = np.repeat(begin[:-1], length) + np.arange(first[-1]) - np.repeat(first[:-1], length)
        counts = [c if f else None for c, f in zip(group_counts(flat, begin), fresh)]
        return pa.RecordBatch.from_arrays([
            ids, pa.array(n), pa.array(names, mask=n == 0), pa.array(counts, pa.binary()), pa.array(small),
            pa.ListArray.from_arrays(pa.array(first), pa.array(order[take].view(np.int64))),
        ], ["_id", "n", "sid", "counts", "n_small", "prefix"])
    return run


# -- cells --------------------------------------------------------------------

def runs(keep_single: bool):
    """Rows (key, part, sid) sorted by all three -> (key, leader, sid) for
    each row of a run of one (key, part), the leader being its first sid.
    Runs of one sid are left out unless kept. Only the last row is carried
    from batch to batch, so a run may be of any length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # key, part, sid, leader, whether the leader's own row is out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, sid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if carried is not None:
                key, part, sid = (np.concatenate(([c], x)) for c, x in zip(carried, (key, part, sid)))
            same = np.concatenate(([False], (key[1:] == key[:-1]) & (part[1:] == part[:-1])))
            kept = ~(same & np.concatenate(([False], sid[1:] == sid[:-1])))
            key, part, sid, same = key[kept], part[kept], sid[kept], same[kept]
            start = np.flatnonzero(~same)
            name = np.cumsum(~same) - 1
            leader, out = sid[start], np.zeros(len(start), bool)
            if carried is not None:
                leader[0], out[0] = carried[3], carried[4]
            members = np.bincount(name, weights=same) > 0
            emit = same.copy()
            emit[start] = (members | keep_single) & ~out
            if carried is not None:
                # The carried row stands for its run; only a leader that is
                # not out yet may still have to be written.
                emit[0] = emit[0] and carried[2] == carried[3]
            out |= members | keep_single
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[emit]), pa.array(leader[name[emit]]), pa.array(sid[emit])], ["key", "leader", "sid"])
            carried = key[-1], part[-1], sid[-1], leader[-1], out[-1]
    return run


def cells_of(scratch: Scratch, features: DataFrame, partitions: int) -> DataFrame:
    """(key, leader, sid): the cells with at least two sets. Large cells are
    first dealt out by set as well, so that one of a third of all sets is
    not one task's work; the leaders of their parts meet in a second pass."""
    schema = "key bigint, leader bigint, sid bigint"

    def grouped(rows: DataFrame, keep_single: bool) -> DataFrame:
        return (rows.repartition(partitions, "key", "part").sortWithinPartitions("key", "part", "sid")
                    .select("key", "part", "sid").mapInArrow(runs(keep_single), schema))

    rows = features.where("counts is not null").select(
        "sid", F.posexplode("prefix").alias("at", "key"), (F.col("at") >= F.col("n_small")).alias("large"))
    part = F.when(F.col("large"), 1 + F.pmod("sid", F.lit(partitions))).otherwise(0).cast("int")
    rows = rows.select("key", part.alias("part"), "sid")
    large = scratch.write(grouped(rows.where("part > 0"), True), "large-cells")
    leaders = large.select("key", F.lit(0).alias("part"), F.col("leader").alias("sid")).distinct()
    small = grouped(rows.where("part = 0"), False)
    return scratch.write(small.union(large).union(grouped(leaders, False)), "cells")


# -- R-tree -------------------------------------------------------------------

class RTree:
    """Count vectors packed into boxes. A box has the largest count of each
    group, the smallest size and the range of components among its points,
    so that its bound holds for every point inside."""

    def __init__(self, counts: np.ndarray, n: np.ndarray, comp: np.ndarray):
        # Slabs of like size, and inside a slab by the group that varies most.
        slab = np.argsort(np.argsort(n, kind="stable")) // (FANOUT * FANOUT)
        widest = counts[:, counts.var(axis=0).argmax()] if len(n) else n
        self.order = np.lexsort((n, widest, slab))
        level = [counts[self.order], n[self.order], comp[self.order], comp[self.order]]
        self.levels = [level]
        while len(level[1]) > FANOUT:
            at = np.arange(0, len(level[1]), FANOUT)
            level = [np.maximum.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at),
                     np.minimum.reduceat(level[2], at), np.maximum.reduceat(level[3], at)]
            self.levels.append(level)

    def search(self, counts: np.ndarray, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs of different components that the bound lets
        through."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        top = len(self.levels[-1][1])
        for begin in range(0, len(n), 512):
            own = np.arange(begin, min(begin + 512, len(n)))
            query, node = np.repeat(own, top), np.tile(np.arange(top), len(own))
            for depth in reversed(range(len(self.levels))):
                query, node = self._through(self.levels[depth], counts, n, comp, query, node)
                if depth:
                    child = node[:, None] * FANOUT + np.arange(FANOUT)
                    inside = child < len(self.levels[depth - 1][1])
                    query, node = np.repeat(query, inside.sum(axis=1)), child[inside]
            found.append((query, self.order[node]))
        return np.concatenate([q for q, _ in found]), np.concatenate([p for _, p in found])

    @staticmethod
    def _through(level, counts, n, comp, query, node):
        most, least, low, high = level
        kept = np.zeros(len(query), bool)
        # What sizes and components rule out needs no bound.
        other = ((low[node] != comp[query]) | (high[node] != comp[query])) & (4 * n[query] >= 3 * least[node])
        some = np.flatnonzero(other)
        step = max(1, (1 << 22) // counts.shape[1])
        for at in range(0, len(some), step):
            own = some[at:at + step]
            q, v = query[own], node[own]
            bound = np.minimum(counts[q], most[v]).sum(axis=1)
            kept[own] = 7 * bound >= required(n[q], least[v])
        return query[kept], node[kept]


def tree_pairs(exhaustive: bool):
    """Rows sorted by (key, band, i, j) -> pairs (a, b), a < b, that the
    bound lets through. A group has at most about ``TILE`` points (role bit
    1) and so many queries (bit 2). Unless ``exhaustive``, a group with many
    pairs sends a forest of its best ones and its key in ``open``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)])
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in rows[:4]], axis=0)) + 1
            edges = [0, *cut.tolist()]
            yield packed([pairs([c[a:b] for c in rows]) for a, b in zip(edges[:-1], edges[1:])])
            held = [[c[edges[-1]:] for c in rows]]
        if held:
            yield packed([pairs([np.concatenate(x) for x in zip(*held)])])

    def pairs(rows: list[np.ndarray]) -> tuple[np.ndarray, int | None]:
        key, role, sid, comp, n, counts = rows[0], *rows[4:]
        point, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        if not len(point) or not len(query) or (comp == comp[0]).all():
            return np.zeros((0, 2), np.int64), None
        fine = points_of(counts, n)
        width = max(1, fine.shape[1] // FINE)
        coarse = fine.reshape(len(fine), -1, width).sum(axis=1)
        tree = RTree(coarse[point], n[point], comp[point])
        found, thinned = [np.zeros((0, 3), np.int64)], False
        for at in range(0, len(query), 512):
            own = query[at:at + 512]
            q, p = tree.search(coarse[own], n[own], comp[own])
            q, p = own[q], point[p]
            for k in range(0, len(q), step := max(1, (1 << 23) // fine.shape[1])):
                a, b = q[k:k + step], p[k:k + step]
                excess = 7 * np.minimum(fine[a], fine[b]).sum(axis=1) - required(n[a], n[b])
                kept = excess >= 0
                # Shares of what is needed, in millionths.
                share = excess[kept] * 1_000_000 // required(n[a], n[b])[kept]
                found.append(np.stack((a[kept], b[kept], share), axis=1))
            if not exhaustive and sum(map(len, found)) > HELD_PAIRS:
                found, thinned = [forest(np.concatenate(found), comp)], True
        found = np.concatenate(found)
        if not thinned and (exhaustive or len(found) <= MANY_PAIRS * len(sid)):
            return distinct(sid[found[:, :2]]), None
        return distinct(sid[forest(found, comp)[:, :2]]), int(key[0])

    def distinct(ends: np.ndarray) -> np.ndarray:
        return np.unique(np.sort(ends, axis=1), axis=0)

    def packed(parts: list[tuple[np.ndarray, int | None]]) -> pa.RecordBatch:
        ends = np.concatenate([*(p for p, _ in parts), np.zeros((0, 2), np.int64)])
        still = [k for _, k in parts if k is not None]
        nothing = [None] * len(still)
        return pa.RecordBatch.from_arrays(
            [pa.array(ends[:, 0].tolist() + nothing, pa.int64()), pa.array(ends[:, 1].tolist() + nothing, pa.int64()),
             pa.array([None] * len(ends) + still, pa.int64())], ["a", "b", "open"])
    return run


def forest(found: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Of pairs (a, b, share) those that join the components best first:
    in rounds, each component takes its best pair to another one. The forest
    of some pairs and later ones is that of all."""
    label = np.unique(comp, return_inverse=True)[1]
    out = [np.zeros((0, 3), np.int64)]
    while True:
        x, y = label[found[:, 0]], label[found[:, 1]]
        found, x, y = (v[x != y] for v in (found, x, y))
        if not len(found):
            return np.concatenate(out)
        order = np.argsort(-found[:, 2], kind="stable")
        found, x, y = found[order], x[order], y[order]
        best = np.unique(np.concatenate([np.unique(side, return_index=True)[1] for side in (x, y)]))
        out.append(found[best])
        root = np.arange(label.max() + 1)
        while True:
            low = root.copy()
            np.minimum.at(low, x[best], root[y[best]])
            np.minimum.at(low, y[best], root[x[best]])
            low = low[low]
            if (low == root).all():
                break
            root = low
        label = root[label]


# -- verification -------------------------------------------------------------

def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many hashes two columns of sorted sets share, row by row."""
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out[i] = np.count_nonzero(y[at] == x)
    return out


@F.arrow_udf(BooleanType())
def linked(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two sets link, from the sets."""
    both = np.array([len(v.as_buffer()) // 8 for v in a]) + np.array([len(v.as_buffer()) // 8 for v in b])
    return pa.array(7 * overlap(a, b) >= 3 * both)


@F.arrow_udf(BooleanType())
def may_link(a: pa.Array, n_a: pa.Array, b: pa.Array, n_b: pa.Array) -> pa.Array:
    """Whether the bound of two count vectors lets a pair through."""
    out = []
    for x, n, y, m in zip(a.to_pylist(), n_a.to_pylist(), b.to_pylist(), n_b.to_pylist()):
        u, v = points_of([x, y], np.array([n, m]))
        out.append(bool(7 * np.minimum(u, v).sum() >= required(n, m)))
    return pa.array(out, pa.bool_())


def sets_for(scratch: Scratch, texts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(sid, hashes) of the sets ``wanted`` (sid, _id), made again from the
    texts. A bitmap of fixed size keeps most other texts from being
    shuffled; it lets some through, and the join drops them."""
    word = F.expr("pmod(xxhash64(_id), 16777216)")
    rows = wanted.select(word.alias("at")).groupBy(F.expr("at div 64").alias("word")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).collect()
    bits = np.zeros(1 << 18, np.uint64)
    for at, value in rows:
        bits[at] = value & (2**64 - 1)
    sent = scratch.spark.sparkContext.broadcast(bits)

    @F.arrow_udf(BooleanType())
    def maybe(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False).astype(np.uint64)
        return pa.array((sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in byte_slices(batch.column(1)):
                flat, begin = sets_of(part)
                own = pa.array([flat[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(set_ids(flat, begin)), own],
                    ["sid", "_made", "hashes"])
                at += len(part)

    joined = texts.where(maybe(word)).join(wanted, texts["_id"].eqNullSafe(wanted["_id"])).select("sid", "_text")
    made = joined.mapInArrow(hashes, "sid bigint, _made bigint, hashes binary").where("sid = _made")
    return scratch.write(made.select("sid", "hashes").dropDuplicates(["sid"]), name)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    a = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("_a"))
    b = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("_b"))
    return pairs.join(b, "b").join(a, "a").where(linked("_a", "_b")).select("a", "b")


def across(scratch: Scratch, texts: DataFrame, points: DataFrame, cells: DataFrame, comps: DataFrame,
           links: DataFrame, partitions: int, name: str, exhaustive: bool) -> tuple[DataFrame, DataFrame]:
    """``links`` and the verified links between different components in
    ``cells`` (key, sid), and the keys of cells that have more to verify."""
    named = cells.join(comps.select(F.col("node").alias("sid"), "comp"), "sid", "left") \
        .withColumn("comp", F.coalesce("comp", "sid"))
    # Cells that hold several components, alike ones once.
    mixed = named.groupBy("key").agg(
        F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count("*").alias("_n"),
        F.sum(F.expr("cast(xxhash64(sid) as decimal(38,0))")).alias("_sum")).where("_low <> _high") \
        .groupBy("_n", "_sum").agg(F.min("key").alias("key"))
    band = F.floor(F.log(BAND, F.col("n"))).cast("int")
    members = scratch.write(
        named.join(mixed.select("key"), "key").join(points.select("sid", "n"), "sid").select(
            "key", "sid", "comp", "n", F.explode(F.array(
                F.struct(band.alias("band"), F.lit(True).alias("own")),
                F.struct((band + 1).alias("band"), F.lit(False).alias("own")))).alias("_b"))
        .select("key", "_b.band", "_b.own", "sid", "comp", "n"), f"{name}-members")
    # Only bands with points, and with more than one component.
    tiles = members.groupBy("key", "band").agg(
        F.ceil(F.count("*") / TILE).cast("int").alias("k"), F.max("own").alias("_some"),
        F.min("comp").alias("_low"), F.max("comp").alias("_high")) \
        .where("_some and _low <> _high").select("key", "band", "k")
    spot = F.expr("""case when k = 1 then array(struct(0 as i, 0 as j, if(own, 3, 2) as role))
        else concat(
          if(own, transform(sequence(0, k - 1), x -> struct(x as i, cast(pmod(sid, k) as int) as j, 1 as role)),
                  array()),
          transform(sequence(0, k - 1), x -> struct(cast(pmod(sid, k) as int) as i, x as j, 2 as role))) end""")
    dealt = members.join(tiles, ["key", "band"]).join(points.select("sid", "counts"), "sid") \
        .withColumn("_s", F.explode(spot)) \
        .select("key", "band", "_s.i", "_s.j", "_s.role", "sid", "comp", "n", "counts")
    found = scratch.write(
        dealt.repartition(partitions, "key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")
             .mapInArrow(tree_pairs(exhaustive), "a bigint, b bigint, open bigint").distinct(), f"{name}-pairs")
    pairs = found.where("a is not null").select("a", "b")
    ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    sets = sets_for(scratch, texts, points.join(ends, "sid").select("sid", "_id"), f"{name}-sets")
    links = scratch.write(links.union(verified(pairs, sets)), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-members")
    return links, found.where("open is not null").select(F.col("open").alias("key")).distinct()


# -- the join -----------------------------------------------------------------

def components_by_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (``id_col``, n_shingles, component_id) per row of ``docs``.

    component_id is the smallest id reachable by links of Jaccard 0.75 or
    more, the row's own included. A text without words (null, empty, white
    space) has no shingles and its own id. Rows of one set are one point
    with one name of 64 bits. Null ids are never the smallest of several;
    repeated rows come back as they are; an empty table gives no rows; other
    columns are not read."""
    narrow, named = set_components(docs, id_col, text_col)
    return narrow.join(named, "sid", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("_low", "_id").alias("component_id"))


def set_components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, n, sid) for every row of ``docs``, sid null without words; and
    (sid, comp, _own, _low) for every set: its component's name, the smallest
    id of its own rows, and that of the whole component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    partitions = shuffle_partitions(spark)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    levels = spark.sparkContext.broadcast(frequency_levels(texts.select("_text"), partitions))
    id_type = texts.schema["_id"].dataType.simpleString()
    features = make_features(levels, float(half_octaves(LARGE_CELL)))
    wide = scratch.write(texts.mapInArrow(features, features_schema(id_type)), "features")
    cells = cells_of(scratch, wide, partitions)
    narrow = scratch.write(wide.select("_id", "n", "sid"), "narrow")

    # Points of the sets that share a cell, and a document of each.
    shared = cells.select("sid").distinct()
    points = scratch.write(
        wide.groupBy("sid").agg(F.first("n").alias("n"), F.first("counts", True).alias("counts"),
                                F.min("_id").alias("_id")).join(shared, "sid"), "points")
    scratch.drop("features", "large-cells")

    def with_points(pairs: DataFrame) -> DataFrame:
        a = points.select(F.col("sid").alias("a"), F.col("counts").alias("_a"), F.col("n").alias("_na"))
        b = points.select(F.col("sid").alias("b"), F.col("counts").alias("_b"), F.col("n").alias("_nb"))
        return pairs.join(b, "b").join(a, "a")

    # Each set against the leader that it shares most cells with.
    best = cells.where("sid <> leader").groupBy("sid", "leader").agg(F.count("*").alias("_cells")) \
        .groupBy("sid").agg(F.max(F.struct("_cells", "leader")).alias("_best")) \
        .select(F.col("_best.leader").alias("a"), F.col("sid").alias("b"))
    first = scratch.write(with_points(best).where(may_link("_a", "_na", "_b", "_nb")).select("a", "b"), "first-pairs")
    ends = first.select(F.col("a").alias("sid")).union(first.select("b")).distinct()
    sets = sets_for(scratch, texts, points.join(ends, "sid").select("sid", "_id"), "first-sets")
    links = scratch.write(verified(first, sets), "first-links")
    scratch.drop("first-sets")
    comps = connected_components(scratch, links, "first")

    # Pairs between components in the cells: first all, or the best of many;
    # then all of the cells that had many, as far as they are still apart.
    every = cells.select("key", "sid").distinct()
    links, still = across(scratch, texts, points, every, comps, links, partitions, "second", False)
    comps = connected_components(scratch, links, "second")
    if not still.isEmpty():
        links, _ = across(scratch, texts, points, every.join(still, "key"), comps, links, partitions, "third", True)
        comps = connected_components(scratch, links, "third")
    scratch.drop("cells")

    # The smallest id of each component, for each set, then for each row.
    own = narrow.where("sid is not null").groupBy("sid").agg(F.min("_id").alias("_low")).join(
        comps.select(F.col("node").alias("sid"), "comp"), "sid")
    own = scratch.write(own, "set-ids")
    low = scratch.write(own.groupBy("comp").agg(F.min("_low").alias("_low")), "component-ids")
    named = scratch.write(own.withColumnRenamed("_low", "_own").join(low, "comp")
                          .select("sid", "comp", "_own", "_low"), "set-components")
    alone = narrow.where("sid is not null").groupBy("sid").agg(F.min("_id").alias("_own")) \
        .join(named.select("sid"), "sid", "left_anti") \
        .select("sid", F.col("sid").alias("comp"), "_own", F.col("_own").alias("_low"))
    return narrow, scratch.write(named.union(alone), "final-components")


def set_name(text: Column) -> Column:
    """The name (sid) of a text's set."""
    @F.arrow_udf(LongType())
    def named(column: pa.Array) -> pa.Array:
        parts = [set_ids(*sets_of(part)) for part in byte_slices(column)]
        return pa.array(np.concatenate(parts) if parts else [], pa.int64())
    return named(text)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each
    component one row stays, one of the smallest id (null only if there is no
    other), and of the sets under that id the one with the smallest name.
    Texts without words link with nothing and all stay."""
    narrow, named = set_components(docs, id_col, text_col)
    kept = named.groupBy("comp").agg(F.min(F.struct(F.col("_own").isNull().alias("_none"), "_own", "sid")).alias("_k")) \
        .select(F.col("_k._own").alias("kept_id"), F.col("_k.sid").alias("kept_sid"))
    # The row as one value, so that no column of it can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # An id names a row when one row with words has it; else the set decides.
    repeated = narrow.where("sid is not null and _id is not null").groupBy("_id").agg(F.count("*").alias("_n")) \
        .where("_n > 1").select(F.col("_id").alias("many"))
    some = not repeated.isEmpty()
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    clear = kept.where("kept_id is not null")
    unclear = rows.where(words & F.col("id").isNull())
    if some:
        clear = clear.join(repeated, F.col("kept_id") == F.col("many"), "left_anti")
        unclear = unclear.union(rows.where(words).join(repeated, F.col("id") == F.col("many"), "left_semi"))
    first = rows.where(words).join(clear, F.col("id") == F.col("kept_id")).select("row")
    if some or not narrow.where("sid is not null and _id is null").isEmpty():
        own = unclear.withColumn("sid", set_name(F.col("text")))
        own = own.join(kept, (F.col("sid") == F.col("kept_sid")) & F.col("id").eqNullSafe(F.col("kept_id"))) \
            .dropDuplicates(["id", "sid"]).select("row")
        first = first.union(own)
    return first.union(rows.where(~words).select("row")).select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_by_ngrams(table(spark, sf_dir, "documents"))
