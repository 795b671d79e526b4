"""Operator 5, near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors become one node. Nodes are dealt to the shards of their
nearest centroids, so that shards overlap; each shard links its nodes to
near and a few far ones, pruned so that no neighbour is hidden behind
another; a node's lists from all its shards are joined. The search starts
every query at a shard's medoid, walks greedily to its neighbourhood and
from there expands over everything in range. What it finds is verified in
double precision; queries that do not find themselves, and a share of all
against brute force, show whether the walk was wide enough, and it is
widened until it was. Before that, a share of the nodes is held against all
others, wherever they are dealt: nodes go to more shards until enough of the
linked pairs share one.

Shards report counts and the links of a spanning forest, never all pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, table
from .components import connected_components

# The centroids are fitted on a bounded sample of the distinct vectors; all
# vectors are dealt to them.
SAMPLE, MAX_CENTROIDS, ROUNDS = 8192, 1024, 6
SHARD_NODES, OVERLAP = 1000, 2
# Nodes of each dimension that are held against all others, and the share of
# their links (of all, and of a node's on average) whose ends must share a
# shard.
DEAL_AUDIT, DEAL_RECALL, DEAL_BLOCK = 4096, 0.99, 1024
# A shard of more nodes is dealt out as pairs of tiles of its queries and
# its nodes.
TILE = 4000
NEAR, FAR, CANDIDATES, FAR_CANDIDATES, ALPHA = 20, 8, 48, 24, 1.2
BEAM, SLACK, CHUNK = 24, 0.05, 256
AUDIT_EVERY, AUDIT_RECALL = 20, 0.98


# -- nodes --------------------------------------------------------------------

def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) -> (id, node, unit): the vector scaled to length one
    in double precision and the 64-bit name of the vector, null where it is
    null, zero, or has a null or non-finite component."""
    for batch in batches:
        node, unit = [], []
        for value in batch.column(1):
            x = None
            if value.is_valid and not value.values.null_count:
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                largest = np.abs(x).max(initial=0.0)
                x = x / largest if np.isfinite(x).all() and largest > 0 else None
            if x is None:
                node.append(None)
                unit.append(None)
                continue
            raw = value.values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
            node.append(int.from_bytes(hashlib.blake2b(raw.tobytes(), digest_size=8).digest(), "little", signed=True))
            unit.append((x / np.sqrt((x * x).sum())).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(node, pa.int64()), pa.array(unit, pa.binary())], ["_id", "node", "unit"])


def matrix(units: pa.Array | list) -> np.ndarray:
    values = units.to_pylist() if isinstance(units, (pa.Array, pa.ChunkedArray)) else units
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def centroids(sample: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means of the sample."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        owner = (sample @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, owner, sample)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], centre)
    return centre


def dealer(sent):
    """(node, unit, copies) -> the same with its shards, the nearest
    centroids of its dimension, smallest shard number first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards: list[list[int]] = []
            for unit in batch.column(1).to_pylist():
                centre, first, overlap = sent.value[len(unit) // 8]
                near = centre @ np.frombuffer(unit, "<f8")
                shards.append(sorted((first + np.argsort(-near, kind="stable")[:overlap]).tolist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shards, pa.list_(pa.int32()))], [*batch.schema.names, "shards"])
    return run


# -- graph --------------------------------------------------------------------

def pruned(x: np.ndarray, own: np.ndarray, candidate: np.ndarray, keep: int) -> np.ndarray:
    """Robust pruning for a block of nodes at once: nearest first, a
    candidate goes when one that was kept is ALPHA times nearer to it than
    the node is. Returns candidates by row, -1 where fewer are kept."""
    place = x[candidate]
    to_node = np.maximum(0, 2 - 2 * np.einsum("bd,bcd->bc", x[own], place))
    order = np.argsort(to_node, axis=1, kind="stable")
    candidate, to_node = np.take_along_axis(candidate, order, 1), np.take_along_axis(to_node, order, 1)
    place = x[candidate]
    between = np.maximum(0, 2 - 2 * np.einsum("bcd,bed->bce", place, place))
    alive = candidate != own[:, None]
    out = np.full((len(own), keep), -1, np.int64)
    row = np.arange(len(own))
    for k in range(keep):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        out[some, k] = candidate[row, at][some]
        # Squared distances: ALPHA counts twice.
        alive &= ALPHA * ALPHA * between[row, at] > to_node
        alive[row, at] = False
    return out


def neighbours(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Neighbour lists of all rows of ``x``, -1 where shorter: near ones and
    some far ones, each pruned, and the near ones' back links."""
    n = len(x)
    if n < 2:
        return np.full((n, 1), -1, np.int64)
    rng = np.random.default_rng(seed)
    near = np.full((n, NEAR), -1, np.int64)
    far = np.full((n, FAR), -1, np.int64)
    take = min(CANDIDATES, n - 1)
    for at in range(0, n, CHUNK):
        own = np.arange(at, min(at + CHUNK, n))
        cosine = x[own] @ x.T
        cosine[np.arange(len(own)), own] = -2
        best = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
        near[own] = pruned(x, own, best, NEAR)
        far[own] = pruned(x, own, rng.integers(0, n, (len(own), FAR_CANDIDATES)), FAR)
    node, rank = np.nonzero(near >= 0)
    target = near[node, rank]
    order = np.lexsort((rank, target))
    node, target = node[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, NEAR), -1, np.int64)
    back[target[place < NEAR], place[place < NEAR]] = node[place < NEAR]
    return np.concatenate((near, far, back), axis=1)


def search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, limit: float, beam: int):
    """(query, row) pairs with cosine at least ``limit``, and for each query
    the rows that were looked at. A walk keeps its ``beam`` best rows and
    opens the best that is not open; then all rows in range (and a little
    beyond) are opened in turn."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m), bool)
    seen[:, start] = True
    best = np.full((n, beam), start, np.int64)
    value = np.full((n, beam), -np.inf)
    value[:, 0] = q @ x[start]
    opened = np.zeros((n, beam), bool)
    opened[:, 1:] = True
    pairs_q, pairs_x, pairs_v = [np.arange(n)], [np.full(n, start)], [value[:, 0].copy()]

    def look(query: np.ndarray, node: np.ndarray):
        """Unseen neighbours of (query, node) pairs with their cosines."""
        near = graph[node]
        who = np.repeat(query, near.shape[1])
        near = near.ravel()
        fresh = near >= 0
        who, near = who[fresh], near[fresh]
        fresh = ~seen[who, near]
        flat = np.unique(who[fresh] * m + near[fresh])
        who, near = flat // m, flat % m
        seen[who, near] = True
        cosine = np.einsum("ij,ij->i", q[who], x[near])
        pairs_q.append(who)
        pairs_x.append(near)
        pairs_v.append(cosine)
        return who, near, cosine

    going = np.arange(n)
    while len(going):
        at = np.where(opened[going], -np.inf, value[going]).argmax(axis=1)
        node = best[going, at]
        opened[going, at] = True
        who, near, cosine = look(going, node)
        if len(who):
            # Merge the new rows of each query into its beam.
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            width = rank.max() + 1
            new = np.zeros((n, width), np.int64)
            new_value = np.full((n, width), -np.inf)
            new[who, rank], new_value[who, rank] = near, cosine
            own = np.unique(who)
            ids = np.concatenate((best[own], new[own]), axis=1)
            values = np.concatenate((value[own], new_value[own]), axis=1)
            flags = np.concatenate((opened[own], ~np.isfinite(new_value[own])), axis=1)
            top = np.argpartition(-values, beam - 1, axis=1)[:, :beam]
            best[own], value[own] = np.take_along_axis(ids, top, 1), np.take_along_axis(values, top, 1)
            opened[own] = np.take_along_axis(flags, top, 1)
        going = going[~opened[going].all(axis=1)]
    all_q, all_x, all_v = (np.concatenate(p) for p in (pairs_q, pairs_x, pairs_v))
    near = all_v >= limit - SLACK
    who, node = all_q[near], all_x[near]
    while len(who):
        who, node, cosine = look(who, node)
        near = cosine >= limit - SLACK
        who, node = who[near], node[near]
    all_q, all_x, all_v = (np.concatenate(p) for p in (pairs_q, pairs_x, pairs_v))
    found = all_v >= limit
    return all_q[found], all_x[found], seen


def audited(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, self_at: np.ndarray, names: np.ndarray,
            limit: float) -> tuple[np.ndarray, np.ndarray]:
    """``search`` with a beam that doubles until every query that is a node
    has met itself and the audited ones (by name) have at least
    ``AUDIT_RECALL`` of what brute force finds; at the widest the walk opens
    every row it can reach."""
    beam = min(BEAM, len(x))
    audit = np.flatnonzero(names % AUDIT_EVERY == 0)
    truth = q[audit] @ x.T >= limit
    while True:
        pair_q, pair_x, seen = search(x, graph, start, q, limit, beam)
        known = self_at >= 0
        lost = known & ~seen[np.arange(len(q)), np.maximum(self_at, 0)]
        recall = (truth & seen[audit]).sum() / max(1, truth.sum())
        if beam >= len(x) or (not lost.any() and recall >= AUDIT_RECALL):
            return pair_q, pair_x
        beam = min(2 * beam, len(x))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with one value of the first ``keys`` columns, from
    rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        names = [rows.column(k).to_numpy() for k in range(keys)]
        cut = [0, *(np.flatnonzero(np.any([np.diff(c) != 0 for c in names], axis=0)) + 1).tolist()]
        for a, b in zip(cut[:-1], cut[1:]):
            yield rows.slice(a, b - a)
        held = rows.slice(cut[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, tile, node, unit) -> (a, b) links of each tile's graph."""
    for rows in groups(batches, 2):
        node, graph = rows["node"].to_numpy(), neighbours(matrix(rows["unit"]))
        at, _ = np.nonzero(graph >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[graph[graph >= 0]])], ["a", "b"])


def find(limit: float):
    """(shard, i, j, role, node, copies, shards, unit, near) -> per node the
    links counted here and one link into its component here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, 3):
            yield one(rows)

    def one(rows: pa.Table) -> pa.RecordBatch:
        shard = rows["shard"][0].as_py()
        role, node, copies = (rows[c].to_numpy() for c in ("role", "node", "copies"))
        unit = matrix(rows["unit"])
        lists = rows["shards"].to_pylist()
        dealt = np.full((len(node), max(map(len, lists))), -1, np.int64)
        for i, own in enumerate(lists):
            dealt[i, :len(own)] = own
        point, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        if len(point) and len(query):
            x = unit[point]
            place = {v: k for k, v in enumerate(node[point].tolist())}
            lists = [[place[v] for v in near or () if v in place] for near in rows["near"].take(point).to_pylist()]
            graph = np.full((len(x), max(1, max(map(len, lists)))), -1, np.int64)
            for k, near in enumerate(lists):
                graph[k, :len(near)] = near
            start = int((x @ x.mean(axis=0)).argmax())
            ends = []
            for at in range(0, len(query), CHUNK):
                own = query[at:at + CHUNK]
                self_at = np.array([place.get(v, -1) for v in node[own].tolist()])
                q, p = audited(x, graph, start, unit[own], self_at, node[own], limit)
                a, b = own[q], point[p]
                other = node[a] != node[b]
                ends.append((a[other], b[other]))
            a, b = (np.concatenate(e) for e in zip(*ends))
            if (role == 3).all():
                # All of the shard, at most TILE nodes: a link that the walk
                # from one end misses and that from the other finds counts
                # for both.
                either = np.zeros((len(node), len(node)), bool)
                either[a, b] = either[b, a] = True
                a, b = np.nonzero(either)
                del either
            # A pair is counted in the first shard that both ends are in.
            before = (dealt >= 0) & (dealt < shard)
            step = max(1, (1 << 22) // dealt.shape[1] ** 2)
            for at in range(0, len(a), step):
                p, q = a[at:at + step], b[at:at + step]
                common = (dealt[p][:, :, None] == dealt[q][:, None, :]) & before[p][:, :, None]
                mine = ~common.any(axis=(1, 2))
                np.add.at(links, p[mine], copies[q[mine]])
            while True:
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                low = low[low]
                if (low == root).all():
                    break
                root = low
        kept = (links > 0) | (root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[kept]), pa.array(links[kept]), pa.array(node[root[kept]])], ["node", "links", "root"])
    return run


# -- Spark --------------------------------------------------------------------

def overlaps(k: int) -> list[int]:
    """The numbers of shards of ``k`` that a node may be dealt to, each
    about half as large again as the one before."""
    out = [min(OVERLAP, k)]
    while out[-1] < k:
        out.append(min(k, out[-1] + max(1, out[-1] // 2)))
    return out


def ranks(centre: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the rank of every centroid, 0 the nearest."""
    order = np.argsort(-(x @ centre.T), axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(len(centre)), order.shape), 1)
    return out


def audited_overlap(nodes: DataFrame, dim: int, centre: np.ndarray, limit: float) -> int:
    """The fewest shards a node of this dimension must be dealt to for
    ``DEAL_RECALL`` of the links of the first ``DEAL_AUDIT`` nodes by name,
    found by brute force against all nodes, to have a shard in common."""
    levels = overlaps(len(centre))
    if len(levels) == 1:
        return levels[0]
    mine = nodes.where(F.octet_length("unit") == 8 * dim)
    rows = mine.orderBy("node").limit(DEAL_AUDIT).select("node", "unit").collect()
    names, q = np.array([r[0] for r in rows], np.int64), matrix([bytes(r[1]) for r in rows])
    sent = nodes.sparkSession.sparkContext.broadcast((names, q, ranks(centre, q), centre))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, q_rank, centre = sent.value
        total = np.zeros((len(names), 1 + len(levels)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DEAL_BLOCK):
                part = batch.slice(at, DEAL_BLOCK)
                node, x = part.column(0).to_numpy(), matrix(part.column(1))
                a, b = np.nonzero(q @ x.T >= limit)
                other = names[a] != node[b]
                a, b = a[other], b[other]
                if not len(a):
                    continue
                held, place = np.unique(b, return_inverse=True)
                x_rank = ranks(centre, x[held])
                step = max(1, (1 << 22) // len(centre))
                for k in range(0, len(a), step):
                    own = a[k:k + step]
                    # They meet when both are dealt to as many as the worse rank of some shard.
                    met = np.maximum(q_rank[own], x_rank[place[k:k + step]]).min(axis=1)
                    np.add.at(total[:, 0], own, 1)
                    for i, level in enumerate(levels):
                        np.add.at(total[:, 1 + i], own[met < level], 1)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["query", "counts"])

    # At most DEAL_AUDIT rows.
    sums = mine.select("node", "unit").mapInArrow(count, "query bigint, counts array<bigint>").groupBy("query").agg(
        *[F.sum(F.col("counts")[i]).alias(f"_{i}") for i in range(1 + len(levels))]).drop("query").collect()
    if not sums:
        return levels[0]
    found = np.array([tuple(r) for r in sums], float)
    share = np.minimum(found[:, 1:].sum(axis=0) / found[:, 0].sum(), (found[:, 1:] / found[:, :1]).mean(axis=0))
    return levels[int((share >= DEAL_RECALL).argmax())]


def fitted_centroids(nodes: DataFrame, limit: float) -> dict[int, tuple[np.ndarray, int, int]]:
    """By dimension: centroids, the number of the first one's shard and how
    many shards a node is dealt to. The centroids are fitted to the first
    ``SAMPLE`` nodes by name (a hash) of each dimension."""
    sizes = nodes.groupBy((F.octet_length("unit") / 8).cast("int").alias("dim")).agg(F.count("*").alias("n")) \
        .orderBy("dim").collect()  # one row for each dimension in use
    out, first = {}, 0
    for dim, n in sizes:
        rows = nodes.where(F.octet_length("unit") == 8 * dim).orderBy("node").limit(SAMPLE).select("unit").collect()
        k = min(MAX_CENTROIDS, -(-n // SHARD_NODES))
        centre = centroids(matrix([bytes(r[0]) for r in rows]), k)
        out[dim] = centre, first, audited_overlap(nodes, dim, centre, limit)
        first += len(centre)
    return out


def link_embeddings(vectors: DataFrame, limit: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """One row (``id_col``, n_links, component_id, kept) per row of
    ``vectors``.

    n_links counts the other rows whose cosine is at least ``limit``;
    component_id is the smallest id reachable over links. Vectors that are
    null, empty, zero, or have null or non-finite components link with
    nothing, and vectors link only with those of their dimension. Rows of
    one vector are one node (named by 64 bits) with that many copies, linked
    with each other. Repeated rows come back as they are; an empty table
    gives no rows; other columns are not read."""
    spark = vectors.sparkSession
    scratch, partitions = Scratch(spark, "embedding-graph"), shuffle_partitions(spark)
    given = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    id_type = given.schema["_id"].dataType.simpleString()
    rows = given.mapInArrow(unit_rows, f"_id {id_type}, node bigint, unit binary")
    rows = scratch.write(rows, "rows")
    nodes = scratch.write(rows.where("node is not null").groupBy("node").agg(
        F.first("unit").alias("unit"), F.count("*").alias("copies")), "nodes")
    sent = spark.sparkContext.broadcast(fitted_centroids(nodes, limit))
    dealt = nodes.select("node", "unit", "copies").mapInArrow(
        dealer(sent), "node bigint, unit binary, copies bigint, shards array<int>")
    dealt = scratch.write(dealt.withColumn("shard", F.explode("shards")), "dealt")
    tiles = dealt.groupBy("shard").agg(F.ceil(F.count("*") / TILE).cast("int").alias("k"))
    dealt = scratch.write(dealt.join(tiles, "shard").withColumn("tile", F.pmod("node", "k").cast("int")), "tiled")

    # Graphs of the shards, and each node's lists as one.
    links = dealt.select("shard", "tile", "node", "unit").repartition(partitions, "shard", "tile") \
        .sortWithinPartitions("shard", "tile").mapInArrow(build, "a bigint, b bigint")
    # At most a graph's width for each shard of a node.
    near = scratch.write(links.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("near")), "near")

    spot = F.expr("""case when k = 1 then array(struct(0 as i, 0 as j, 3 as role))
        else concat(transform(sequence(0, k - 1), x -> struct(x as i, tile as j, 1 as role)),
                    transform(sequence(0, k - 1), x -> struct(tile as i, x as j, 2 as role))) end""")
    placed = dealt.join(near, "node", "left").withColumn("_s", F.explode(spot)).select(
        "shard", "_s.i", "_s.j", "_s.role", "node", "copies", "shards", "unit",
        F.when(F.col("_s.role") != 2, F.col("near")).alias("near"))
    found = scratch.write(
        placed.repartition(partitions, "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
              .mapInArrow(find(limit), "node bigint, links bigint, root bigint"), "found")
    comps = connected_components(scratch, found.where("node <> root").select(
        F.col("node").alias("a"), F.col("root").alias("b")))

    total = found.groupBy("node").agg(F.sum("links").alias("_links"))
    own = rows.where("node is not null").groupBy("node").agg(F.min("_id").alias("_low"), F.count("*").alias("_copies")) \
        .join(total, "node", "left").join(comps, "node", "left") \
        .select("node", "_low", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"),
                F.coalesce("comp", "node").alias("comp"))
    own = scratch.write(own, "own")
    low = scratch.write(own.groupBy("comp").agg(F.min("_low").alias("_least")), "least")
    own = scratch.write(own.select("node", "_links", "comp").join(low, "comp")
                        .select("node", "_links", "_least"), "named")
    scratch.drop("nodes", "dealt", "tiled", "near", "found", "own", "least")  # nothing reads them any more
    out = rows.select("_id", "node").join(own, "node", "left").select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_least", "_id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def brute_links(vectors: DataFrame, limit: float = 0.9, every: int = 20, id_col: str = "vec_id",
                vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """(``id_col``, n_links) by brute force for the rows whose id is
    divisible by ``every``, against all rows in blocks: what recall is
    measured with. The queries are collected, so this is for audits."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    rows = given.mapInArrow(unit_rows, f"_id {given.schema['_id'].dataType.simpleString()}, node bigint, unit binary") \
        .where("unit is not null")
    queries = rows.where(F.col("_id") % every == 0).collect()
    ids = np.array([r["_id"] for r in queries], np.int64)
    sent = spark.sparkContext.broadcast(matrix([bytes(r["unit"]) for r in queries]) if queries else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows and sent.value is not None:
                total += (sent.value @ matrix(batch.column(2)).T >= limit).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["_id", "n"])

    return rows.mapInArrow(count, "_id bigint, n bigint").groupBy(F.col("_id").alias(id_col)) \
        .agg((F.sum("n") - 1).alias("n_links"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))
