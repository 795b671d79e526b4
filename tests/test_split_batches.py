"""R1/R2 splits and K1/K2 batches."""

import math

import pytest
from pyspark.sql import functions as F

from parlance.operators import batches as KB
from parlance.operators import encode as EN
from parlance.operators import split as SPL


@pytest.mark.parametrize("exact", [False, True])
def test_split_disjoint_complete_and_stable(spark, exact):
    df = spark.range(0, 2000).withColumnRenamed("id", "k")
    a, _ = SPL.assign_split(df, 0.15, "k", 42, exact)
    b, _ = SPL.assign_split(df.repartition(13), 0.15, "k", 42, exact)
    ra = {r["k"]: r["is_test"] for r in a.collect()}
    rb = {r["k"]: r["is_test"] for r in b.collect()}
    assert ra == rb and len(ra) == 2000
    n_test = sum(ra.values())
    if exact:
        assert n_test == math.ceil(2000 * 0.15)
    else:
        assert abs(n_test - 300) < 60


def test_unseeded_split_records_seed(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    a, seed = SPL.assign_split(df, 0.1, "k", None)
    b, seed2 = SPL.assign_split(df, 0.1, "k", seed)
    assert seed2 == seed and sorted(a.collect()) == sorted(b.collect())


def test_encode_unknown_and_empty(spark):
    ids = EN.vocab_ids(spark.createDataFrame([("b",), ("a",)], "ch string"))
    df = spark.createDataFrame([(0, "abz"), (1, ""), (2, None)], "id int, text string")
    got = {r["id"]: list(r["input_ids"]) for r in EN.encode_chars(df, "text", ids).collect()}
    assert got == {0: [2, 3, EN.UNK_ID], 1: [], 2: []}


def _token_cases(spark):
    lengths = [249, 250, 251, 299, 300, 3, 4]
    rows = [(i, list(range(1, n + 1)), [[float(i), float(j)] for j in range(n // 50 + i % 2)])
            for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "k int, input_ids array<int>, labels array<array<float>>")


@pytest.mark.parametrize("reduction", [1, 2])
def test_pad_batches(spark, reduction):
    df = _token_cases(spark)
    out = KB.pad_batches(df, 3, ["k"], reduction=reduction).orderBy("k").collect()
    assert [r["batch_no"] for r in out] == [0, 0, 0, 1, 1, 1, 2]
    for b in (0, 1, 2):
        rows = [r for r in out if r["batch_no"] == b]
        assert len({len(r["input_ids"]) for r in rows}) == 1
        assert all(list(r["input_ids"])[:len(r["input_ids"])] for r in rows)
    r1 = out[1]  # 250 ids in a batch whose longest is 251
    assert len(r1["input_ids"]) == 251 and r1["input_ids"][-1] == 0
    src = {r["k"]: r for r in df.collect()}
    for b in (0, 1, 2):
        rows = [r for r in out if r["batch_no"] == b]
        n = [len(src[r["k"]]["labels"]) for r in rows]
        want = max(n) if reduction == 1 else max(x - x % reduction for x in n)
        for r in rows:
            assert len(r["labels"]) == want
            orig = len(src[r["k"]]["labels"])
            for j, fr in enumerate(r["labels"]):
                assert (list(fr) == [-100.0, -100.0]) == (j >= orig)


def test_pad_batches_partition_invariant(spark):
    df = _token_cases(spark)
    a = KB.pad_batches(df, 2, ["k"]).collect()
    b = KB.pad_batches(df.repartition(5), 2, ["k"], ).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_encode_large_vocabulary(spark):
    """30,000 characters, no key: the ids of a Python dict."""
    chars = [chr(c) for c in range(0x3400, 0x3400 + 30_000)] + ["\U0001f642", "a"]
    vocab = spark.createDataFrame([(c,) for c in chars], "ch string")
    ids = {c: i + EN.FIRST_ID for i, c in enumerate(sorted(chars))}
    texts = ["".join(chars[::997]), "a\U0001f642z", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in EN.encode_chars(df, "text", EN.vocab_ids(vocab)).collect():
        assert list(r["input_ids"]) == [ids.get(c, EN.UNK_ID) for c in texts[r["id"]] or ""]


def test_batches_plan_without_a_join(spark):
    df = spark.createDataFrame([(i, [1] * (i % 5)) for i in range(40)], "id int, input_ids array<int>")
    out = KB.pad_batches(df.withColumn("vector", F.array(F.lit(0.5))), 8, ["id"], labels_col=None)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1  # the ordinal's own
    assert {len(r["input_ids"]) for r in out.collect()} == {4} and "vector" in out.columns


@pytest.mark.parametrize("digits,few", [(4, 1 << 16), (1, 1), (2, 10)])
def test_exact_split_by_counting_digits(spark, monkeypatch, digits, few):
    """The same rows as sorting all hashes, whatever is counted at a time."""
    import hashlib

    monkeypatch.setattr(SPL, "DIGITS", digits)
    monkeypatch.setattr(SPL, "FEW", few)
    keys = [f"k{i}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(3)
    for fraction in (0.15, 0.0, 1.0, 0.001, 1 / 3):
        marked, _ = SPL.assign_split(df, fraction, "k", 42, exact=True)
        order = sorted(keys, key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
        assert {r["k"] for r in marked.where("is_test").collect()} == set(order[:math.ceil(round(300 * fraction, 9))])


def test_exact_split_keeps_repeated_and_null_keys_together(spark):
    rows = [("hot",)] * 400 + [(None,)] * 100 + [(f"k{i}",) for i in range(500)]
    df = spark.createDataFrame(rows, "k string").repartition(4)
    marked, _ = SPL.assign_split(df, 0.3, "k", 42, exact=True)
    sides = marked.groupBy("k").agg(F.count_distinct("is_test").alias("n")).where("n <> 1").count()
    n_test = marked.where("is_test").count()
    assert sides == 0 and marked.where("is_test is null").count() == 0 and 300 <= n_test < 300 + 400
    assert SPL.assign_split(df.where("false"), 0.3, "k", 42, exact=True)[0].count() == 0


def test_exact_split_moves_no_rows(spark):
    marked, _ = SPL.assign_split(spark.range(1000), 0.15, "id", 42, exact=True)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
