"""Ordinal numbering, speaker groups (nulls, bands, ties) and ranking."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import speakers as SP
from parlance.operators.ordinal import sequence


def _hot_frame(spark, n=3000):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"k{rnd.randrange(40)}")
        rows.append((k, rnd.randrange(50), i))
    return spark.createDataFrame(rows, "k string, score int, pos long")


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_sequence_equals_row_number(spark, parts):
    df = _hot_frame(spark)
    got = sequence(df, [F.col("score").desc(), "pos"], keys=["k"], name="s", partitions=parts)
    w = Window.partitionBy("k").orderBy(F.col("score").desc(), "pos")
    want = df.withColumn("s", F.row_number().over(w).cast("long"))
    assert sorted(got.collect(), key=str) == sorted(want.select(*got.columns).collect(), key=str)


def test_sequence_global(spark):
    df = _hot_frame(spark, 500)
    got = sequence(df, ["score", "pos"], name="s", partitions=7).orderBy("s").collect()
    assert [r["s"] for r in got] == list(range(1, 501))
    assert [(r["score"], r["pos"]) for r in got] == sorted((r["score"], r["pos"]) for r in df.collect())


SIZES = {"g4": 4, "g5": 5, "g6": 6, "g99": 99, "g100": 100, "g400": 400, "g401": 401, None: 120}


@pytest.fixture(scope="module")
def speakers_df(spark):
    rows, pos = [], 0
    rnd = random.Random(5)
    keys = [k for k, n in SIZES.items() for _ in range(n)]
    rnd.shuffle(keys)  # first appearance not in id order
    for k in keys:
        rows.append((pos, k, "x" * (10 + pos % 3), 2.0))
        pos += 1
    return spark.createDataFrame(rows, "pos long, speaker_id string, text string, duration double") \
                .withColumn("source_no", F.lit(0))


def test_counts_band_and_null_group(speakers_df):
    counts = {r["speaker_id"]: r["n"] for r in SP.speaker_counts(speakers_df).collect()}
    assert counts == SIZES
    kept = SP.speaker_band(speakers_df, 100, 400)
    assert {r[0] for r in kept.select("speaker_id").distinct().collect()} == {"g100", "g400", None}
    assert SP.band_summary(kept).first()["n_speakers"] == 3
    five = SP.min_rows_per_speaker(speakers_df, 5)
    assert {r[0] for r in five.select("speaker_id").distinct().collect()} == set(SIZES) - {"g4"}


def test_summary_and_histogram(spark, speakers_df):
    counts = SP.speaker_counts(speakers_df)
    s = SP.speaker_summary(counts).first()
    assert s["n_speakers"] == 8 and s["mean_rows_per_speaker"] == sum(SIZES.values()) / 8
    h = SP.count_histogram(counts, 20).orderBy("bin").collect()
    assert len(h) == 20 and sum(r["n_speakers"] for r in h) == 8
    assert h[-1]["n_speakers"] == 2 and h[0]["n_speakers"] == 3  # 400 and 401 (closed) in the last bin
    one = spark.createDataFrame([("a", 7)], "speaker_id string, n long")
    h1 = SP.count_histogram(one, 20).collect()
    assert sum(r["n_speakers"] for r in h1) == 1


def test_ties_keep_source_order(spark):
    rows = [(p, "s", "abcdefghij", 2.0) for p in (5, 1, 9, 3, 7, 2)]
    df = spark.createDataFrame(rows, "pos long, speaker_id string, text string, duration double") \
              .withColumn("source_no", F.lit(0))
    ranked = SP.rank_clips(df).orderBy("clip_rank").collect()
    assert [r["pos"] for r in ranked] == [1, 2, 3, 5, 7, 9]
    top = SP.top_clips(df, 5).orderBy("clip_rank").collect()
    assert [r["pos"] for r in top] == [1, 2, 3, 5, 7]


def test_voice_table_and_first_speakers(speakers_df):
    v = SP.voice_table(SP.min_rows_per_speaker(speakers_df, 5), 5)
    per = {r["speaker_id"]: r for r in v.groupBy("speaker_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_conditioning").cast("int")).alias("c"),
        F.max("clip_rank").alias("mx"), F.first("total_duration").alias("t")).collect()}
    assert per["g5"]["n"] == 5 and per["g5"]["c"] == 5 and per["g401"]["mx"] == 401
    assert per[None]["c"] == 5 and per[None]["t"] == 240.0
    first = [r["speaker_id"] for r in SP.first_speakers(speakers_df, 3).collect()]
    order = [r["speaker_id"] for r in speakers_df.orderBy("pos").collect()]
    seen = []
    for k in order:
        if k not in seen:
            seen.append(k)
    assert first == seen[:3]


def test_vocab_and_missing(spark):
    a = spark.createDataFrame([("ab",), ("cé",)], "text string")
    b = spark.createDataFrame([("abc",)], "text string")
    va, vb = SP.char_vocab(a), SP.char_vocab(b)
    assert {r[0] for r in va.collect()} == {"a", "b", "c", "é", " "}
    assert {r[0] for r in vb.collect()} == {"a", "b", "c"}  # one row: no joining space
    assert {r[0] for r in SP.missing_chars(va, vb).collect()} == {"é", " "}


def test_hot_key_is_spread_over_partitions(spark):
    """A key holding a third of the rows is numbered by many tasks."""
    from parlance.operators import ordinal
    df = _hot_frame(spark, 6000)
    sort = [F.col("k").asc_nulls_first(), F.col("score").desc(), F.col("pos")]
    ranged = df.repartitionByRange(8, *sort).withColumn("p", F.spark_partition_id())
    parts = {r["p"] for r in ranged.where(F.col("k") == "hot").select("p").distinct().collect()}
    assert len(parts) >= 2
    cores = spark.sparkContext.defaultParallelism
    assert ordinal.target_partitions(df) == cores
    big = spark.range(10**12)  # its estimate is 8 TB; nothing is computed
    assert ordinal.target_partitions(big) == -(-8 * 10**12 // ordinal.TARGET_PARTITION_BYTES)
