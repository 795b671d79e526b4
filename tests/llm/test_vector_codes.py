"""Vector codes against plain loops over all entries."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import common, vector_codes


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label) of equal lengths -> ({id: (code, error, label error)}, digest)."""
    rows = sorted(rows, key=lambda r: r[0])
    cut = [[[int(np.floor(4096 * float(c))) for c in v[p * len(v) // parts:(p + 1) * len(v) // parts]]
            for p in range(parts)] for _, v, _ in rows]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got) if g == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, by_label = {}, {}
    for (i, _, label), c in zip(rows, cut):
        near = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        out[i] = ["".join(f"{e:02x}" for _, e in near), error, label]
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, by_label[lab]) for i, (c, e, lab) in out.items()}, digest


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def coded(frame):
    found, books = vector_codes.compress(frame)
    return {r["vec_id"]: (r["code"], r["error"]) for r in found.collect()}, vector_codes.codebook_digest(books)


@pytest.mark.parametrize("n,spread", [(300, 1.0), (300, 0.001), (9, 1.0)])
def test_equals_brute_force(spark, n, spread):
    rng = np.random.default_rng(n)
    x = (rng.standard_normal((n, 16)) * spread).astype(np.float32)
    x[n // 3:2 * n // 3] = x[0]  # a third of the rows are copies
    rows = [(i * 3 % 1009, v.tolist(), None if i % 4 == 0 else i % 3) for i, v in enumerate(x)]
    got, digest = coded(vectors(spark, rows).repartition(3))
    want, want_digest = brute(rows)
    assert got == {k: v[:2] for k, v in want.items()} and digest == want_digest


def test_the_query_with_label_errors(spark):
    import duckdb

    from parlance.llm.sql import ORACLE

    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, vector_codes.op13(spark, folder).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == sorted(con.execute(ORACLE["op13_vector_codes"]).fetchall())
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    want, digest = brute(rows)
    assert {r[0]: r[1:4] for r in got} == want and {r[4] for r in got} == {digest}


def test_search_takes_the_lowest_of_equal_entries():
    rng = np.random.default_rng(5)
    for _ in range(200):
        book = rng.integers(-3, 4, (int(rng.integers(1, 17)), 2))
        points = rng.integers(-4, 5, (100, 2))
        got, gap = vector_codes.orchard_search(points, book, vector_codes.neighbour_lists(book))
        gaps = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (got == gaps.argmin(1)).all() and (gap == gaps.min(1)).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    base = [0.5, -0.25, 1.0, 0.0, -1.0, 2.0, 0.125, -0.0001]
    rows = [(1, base, 1), (1, base, 1), (2, None, 1), (3, [nan, *base[1:]], 1), (4, [inf, *base[1:]], 1),
            (5, [None, *base[1:]], 1), (6, base[:7], 2), (7, [], 2), (8, [1e9, *base[1:]], 2), (None, base[::-1], None),
            (9, [*base, *base], 2)]
    frame = vectors(spark, rows).withColumns({"_id": F.lit("x"), "code": F.lit(1), "ints": F.lit(2), "_vector": F.lit(3)})
    found, books = vector_codes.compress(frame)
    got = sorted(((r["vec_id"], r["code"], r["error"]) for r in found.collect()), key=str)
    # Copies share the lower entry; other lengths and huge ones have no code.
    assert got == sorted([(1, "00" * 8, 0), (1, "00" * 8, 0), (6, None, None), (7, None, None), (8, None, None),
                          (9, None, None), (None, "02" * 8, 0)], key=str)
    assert books.shape == (8, 3, 1)


def test_empty_table_and_nothing_codable(spark):
    assert coded(vectors(spark, []))[0] == {}
    assert coded(vectors(spark, [(1, [1.0, 2.0], 1)]))[0] == {1: (None, None)}


def test_long_lookups_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    rows = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("k"))
    lookup = spark.createDataFrame([(None, "n"), (1, "a"), (2, "b"), (3, "c")], "k long, v string")
    got = common.with_lookup(rows, lookup, ["k"], F.col("id")).orderBy("id").collect()
    assert [r["v"] for r in got] == [{0: "n", 1: "a", 2: "b", 3: "c", 4: None}[i % 5] for i in range(100)]
    assert got[0].asDict().keys() == {"id", "k", "v"}
