"""The embedding graph against brute force."""

import numpy as np
import pytest

from parlance.llm import embedding_graph


def brute(rows, limit=0.9):
    """rows: (id, vector) -> sorted (id, n_links, component)."""
    usable = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    n_links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in usable:
        for j in usable:
            a, b = (np.array(rows[k][1], float) for k in (i, j))
            if j < i and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= limit:
                n_links[i] += 1
                n_links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(x for x in (low.get(find(i)), k) if x is not None) if (
            k is not None or low.get(find(i)) is not None) else None
    return sorted((k, n_links[i], low[find(i)]) for i, (k, _) in enumerate(rows))


def clustered(rng, n, dim=16):
    centre = rng.standard_normal((max(1, n // 12), dim))
    x = centre[rng.integers(0, len(centre), n)] + 0.25 * rng.standard_normal((n, dim)) * rng.random((n, 1))
    x[rng.integers(0, n, n // 10)] = x[0]
    return x.astype(np.float32)


def got(frame):
    rows = embedding_graph.link_embeddings(frame).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows)


def test_equals_brute_force(spark):
    x = clustered(np.random.default_rng(1), 400)
    rows = [(int(i * 7 % 1000), v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(frame) == brute(rows)


@pytest.mark.parametrize("tile", [60, 4000])
def test_many_shards_and_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_graph, "SHARD_NODES", 100)
    monkeypatch.setattr(embedding_graph, "TILE", tile)
    x = clustered(np.random.default_rng(2), 600)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, found = brute(rows), got(frame)
    total = sum(n for _, n, _ in want)
    assert all(b <= a for (_, a, _), (_, b, _) in zip(want, found))  # nothing below the limit
    assert sum(n for _, n, _ in found) >= 0.95 * total


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, []), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e-300, 0.0]), (13, [1e300, 1e300]),
            (3, [1.0, 0.0]), (14, [0.9, 0.2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "vec_id", "embedding", "'x' as node", "1 as unit")
    assert got(frame) == brute(rows)
    assert embedding_graph.link_embeddings(frame.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r["n_links"], r["component_id"]) for r in embedding_graph.link_embeddings(nulls).collect()} == {(1, 1)}


def test_recall_is_measured_by_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    some = vectors.withColumn("vec_id", vectors["vec_id"])
    found = {r["vec_id"]: r["n_links"] for r in embedding_graph.link_embeddings(some, 0.45).collect()}
    true = {r["vec_id"]: r["n_links"] for r in embedding_graph.brute_links(some, 0.45).collect()}
    assert set(true) == {k for k in found if k % 20 == 0}
    assert sum(found[k] for k in true) >= 0.9 * sum(true.values())


def test_pruning_keeps_the_nearest_and_no_hidden_one():
    x = np.array([[1, 0], [0.99, 0.141], [0.98, 0.199], [0, 1], [-1, 0]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = embedding_graph.pruned(x, np.array([0]), np.array([[1, 2, 3, 4, 0]]), 4)[0]
    assert out[0] == 1 and 2 not in out and 0 not in out


def test_walk_widens_until_audited():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_graph.neighbours(x)
    q, p = embedding_graph.audited(x, graph, 0, x, np.arange(300), np.arange(300), 0.8)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.8))}
    pairs = set(zip(q.tolist(), p.tolist()))
    assert pairs <= want and len(pairs) >= 0.95 * len(want)


def test_links_across_shards_are_kept(spark):
    """Unclustered vectors in 21 shards, with planted pairs that the two
    nearest centroids often part."""
    rng = np.random.default_rng(11)
    n, planted, dim = 20_600, 1200, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((planted, dim))
    side -= (side * x[:planted]).sum(axis=1, keepdims=True) * x[:planted]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 0.95, (planted, 1))
    x[planted:2 * planted] = cosine * x[:planted] + np.sqrt(1 - cosine * cosine) * side
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_graph.link_embeddings(frame).collect()}
    assert all(found[i] in ((0, i), (1, i)) for i in range(planted))
    assert all(found[i] == (0, i) for i in range(2 * planted, n))
    assert sum(found[planted + i] == (1, i) for i in range(planted)) >= 0.96 * planted
