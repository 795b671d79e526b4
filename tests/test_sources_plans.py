"""Sources, stages, export, plan shapes and the driver contract."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from parlance.operators import speakers as SP
from parlance.operators import split as SPL
from parlance.operators import batches as KB
from parlance.sources import corpus as SC
from parlance.sources import export as EX
from parlance.sources import stages as ST
from parlance.sources import proxies as px

from conftest import SF_SMALL


def _scratch(kind):
    return tempfile.mkdtemp(prefix=f"parlance-test-{kind}-")


def test_read_corpus_positions_multi_file(spark):
    d = _scratch("multi")
    spark.range(0, 30).repartition(1).write.parquet(f"{d}/a")
    spark.range(30, 50).repartition(1).write.parquet(f"{d}/b")
    df = SC.read_corpus(spark, [f"{d}/a", f"{d}/b"])
    rows = sorted((r["id"], r["pos"]) for r in df.collect())
    assert [p for _, p in rows] == list(range(50))
    assert SC.head(df, 5).count() == 5


def test_read_head_opens_only_the_first_files(spark):
    d = _scratch("head")
    for k in range(6):
        spark.range(10 * k, 10 * k + 10).repartition(1).write.parquet(f"{d}/{k}")
    paths = [f"{d}/{k}" for k in range(6)]
    df = SC.read_head(spark, paths, 13)
    assert sorted(r["id"] for r in df.collect()) == list(range(13)) and len(df.inputFiles()) == 2
    assert SC.read_head(spark, paths, 0).count() == 0
    assert SC.read_head(spark, paths, 1000).count() == 60


def test_load_sources_skip_fallback_raise(spark):
    good = SC.SourceSpec(px.table_path(SF_SMALL, "conversations"), rename={"role": "speaker_id"},
                         keep=["text", "speaker_id"], head=10)
    bad = SC.SourceSpec(px.table_path(SF_SMALL, "missing_table"))
    df, skipped = SC.load_sources(spark, [bad, good])
    assert df.count() == 10 and len(skipped) == 1 and set(df.columns) == {"text", "speaker_id", "source_no", "pos"}
    fb = SC.SourceSpec(px.table_path(SF_SMALL, "documents"), head=3)
    df2, _ = SC.load_sources(spark, [bad], fallback=fb)
    assert df2.count() == 200  # fallback is read in full
    with pytest.raises(RuntimeError):
        SC.load_sources(spark, [bad])


def test_default_speaker_only_when_absent(spark):
    df = spark.createDataFrame([(0, None), (1, "a")], "pos long, speaker_id string")
    assert SC.default_speaker(df).collect() == df.collect()
    d2 = SC.default_speaker(df.drop("speaker_id"))
    assert [r["speaker_id"] for r in d2.orderBy("pos").collect()] == ["speaker_0", "speaker_1"]


def test_concat_differing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "a int, text string")
    b = spark.createDataFrame([("y", 2.0)], "text string, extra double")
    out = SC.concat_sources([a, b])
    assert set(out.columns) == {"a", "text", "extra"} and out.count() == 2


def test_stage_reuse_and_stale_parameters(spark):
    root = _scratch("stages")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    s1 = ST.stage(spark, "s", build, root, {"th": 1})
    s2 = ST.stage(spark, "s", build, root, {"th": 1})
    s3 = ST.stage(spark, "s", build, root, {"th": 2})
    s4 = ST.stage(spark, "s", build, root, {"th": 1}, force=True)
    assert (s1.reused, s2.reused, s3.reused, s4.reused) == (False, True, False, False)
    assert len(calls) == 3 and s3.path != s1.path
    assert len(ST.clear_stages(spark, root)) == 2
    assert not ST.stage(spark, "s", build, root, {"th": 1}).reused


def test_concat_rejects_clashing_types(spark):
    a = spark.createDataFrame([(1,)], "v int")
    b = spark.createDataFrame([("abc",)], "v string")
    with pytest.raises(TypeError, match="column v"):
        SC.concat_sources([a, b])


def test_corrupt_source_is_skipped_but_a_bug_is_raised(spark):
    d = _scratch("garbage")
    with open(f"{d}/part-0.parquet", "wb") as f:
        f.write(b"this is no parquet file")
    good = SC.SourceSpec(px.table_path(SF_SMALL, "conversations"), head=10)
    df, skipped = SC.load_sources(spark, [SC.SourceSpec(d), good])
    assert df.count() == 10 and len(skipped) == 1

    def broken(df):
        raise KeyError("a mistake in the adapter")

    with pytest.raises(KeyError):
        SC.load_sources(spark, [SC.SourceSpec(good.path, prepare=broken), good])


def test_clear_stages_leaves_other_folders(spark):
    root = _scratch("clear")
    os.makedirs(f"{root}/mine")
    made = ST.stage(spark, "s", lambda: spark.range(3), root)
    assert [p.rsplit("/", 1)[1] for p in ST.clear_stages(spark, root)] == [made.path.rsplit("/", 1)[1]]
    assert os.listdir(root) == ["mine"]


def test_null_text_is_rejected(spark):
    from parlance.operators import quality as Q

    df = spark.createDataFrame([(None, 5.0), ("long enough text", None), ("long enough text", 5.0)],
                               "text string, duration double")
    marked = Q.with_reject_reason(df).collect()
    assert [r["reject_reason"] for r in marked] == ["text_length", "duration", None]
    assert Q.quality_filter_b(df).count() == 1


def test_pipelines_reuse_their_stages(spark):
    from parlance.plans import registry as R
    from parlance.plans import voices as C

    root = _scratch("pipeline-stages")
    first = C.run(spark, R._voiced_sources(spark, SF_SMALL), signal=R._signal_c(spark, SF_SMALL), stage_root=root)
    names = sorted(os.listdir(root))
    again = C.run(spark, R._voiced_sources(spark, SF_SMALL), signal=R._signal_c(spark, SF_SMALL), stage_root=root)
    assert sorted(os.listdir(root)) == names and len(names) == 1
    assert first.prepared.count() == again.prepared.count() > 0
    assert "signal" in first.conditioning.columns and first.rejects is not None


def test_write_voices_keeps_speakers_apart(spark):
    rows = [("007", 1, "a"), ("007", 2, "b"), (None, 1, "c"), ("", 1, "d"), ("none", 1, "e"), ("x/y z", 1, "f")]
    df = spark.createDataFrame(rows, "speaker_id string, clip_rank long, text string")
    want = sorted([(s, r - 1, t) for s, r, t in rows], key=str)
    path = _scratch("voices") + "/out"
    EX.write_voices(df, path)
    assert sorted((tuple(r) for r in EX.read_voices(spark, path).collect()), key=str) == want
    assert len([n for n in os.listdir(path) if n.startswith("voice=")]) == 5
    path = _scratch("voices") + "/buckets"
    EX.write_voices(df, path, buckets=2)
    assert sorted((tuple(r) for r in EX.read_voices(spark, path).collect()), key=str) == want
    assert len([n for n in os.listdir(path) if n.startswith("voice=")]) <= 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    d = px.documents_corpus(spark, SF_SMALL).withColumn("duration", F.lit(2.0))
    top = SP.top_clips(d, 5)
    top.collect()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    split, _ = SPL.assign_split(d, 0.15, "doc_id", 42)
    p = _plan(split)
    # the only exchange allowed is the round-robin spread of a one-split scan
    for bad in ("hashpartitioning", "rangepartitioning", "SinglePartition", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in p, bad
    head = SC.head(SC.read_corpus(spark, px.table_path(SF_SMALL, "documents")), 10).select("doc_id")
    hp = _plan(head)
    assert "hashpartitioning" not in hp and "SinglePartition" not in hp


def test_normaliser_is_planned_once(spark):
    """The voices filter normalises the rows that pass the duration test, in
    one expression."""
    from parlance.plans import voices as C

    d = px.conversations_corpus(spark, SF_SMALL)
    kept = C.prepare_text(d)
    assert "regexp_replace" not in _plan(kept)  # read back, not normalised again
    assert kept.count() < d.count()


def test_length_filter_does_not_repeat_the_normaliser(spark):
    from parlance.plans import voices as C

    d = px.documents_corpus(spark, SF_SMALL).withColumn("duration", F.lit(3.0))
    plan = C.normalised_clips(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and "_made" not in plan.split("\n")[0]  # T4 and T5, once


def test_partitions_of_a_checkpoint_are_counted(spark):
    """A checkpoint of joins carries an estimate that multiplied at each."""
    from parlance.operators import ordinal
    from parlance.session import stable

    a = spark.range(10**6).select(F.col("id").alias("a"))
    wide = stable(a.crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("b")))).limit(10))
    joined = stable(wide.join(wide.withColumnRenamed("b", "c"), "a").repartition(7))
    assert ordinal.target_partitions(joined) == max(7, spark.sparkContext.defaultParallelism)


def test_conditioning_does_not_join_the_corpus(spark):
    from parlance.plans import voices as C

    out = C.conditioning_clips(C.prepare_text(px.conversations_corpus(spark, SF_SMALL)))
    out.collect()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftSemi" not in plan


def test_entry_contract(spark):
    out = E.entry(spark)
    rows = out.collect()
    assert len(rows) > 0 and out.columns == ["speaker_id", "clip_rank", "text", "duration", "total_duration"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_runs_small(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SF_SMALL)
        assert df.count() > 0, name
