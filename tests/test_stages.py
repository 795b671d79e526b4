"""Stage identity and publication (S4), and sources with broken files (S3)."""

import os
import subprocess
import sys
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from parlance.operators import segments as SEG
from parlance.plans import enhanced as B
from parlance.plans import voices as C
from parlance.sources import corpus as SC
from parlance.sources import identity as ID
from parlance.sources import stages as ST


def _folder(kind):
    return tempfile.mkdtemp(prefix=f"parlance-test-{kind}-")


def _jobs(spark, fn):
    """(result, number of Spark jobs that it ran)."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture
def corpus(spark):
    """A source of 40 clips in two files, with signals in a column."""
    path = _folder("corpus") + "/source"
    signal = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.sin((i + F.col("id")).cast("double")))
    text = F.concat(F.lit("una frase di prova numero "), F.repeat(F.lit("x"), (F.col("id") / 10 + 1).cast("int")))
    df = spark.range(40).select(text.alias("text"),
                                (F.col("id") % 3).cast("string").alias("speaker_id"), signal.alias("x"), "id")
    df.repartition(2).write.parquet(path)
    return path


SIGNAL = C.SignalSpec("x", 8, 8, 0.5)


def _adapt(df):
    return df.withColumn("extra", F.lit(1))


def _adapt_otherwise(df):
    return df.withColumn("extra", F.lit(2))


def test_a_hit_runs_no_job_and_gives_the_same(spark, corpus):
    root, specs = _folder("root"), [SC.SourceSpec(corpus, prepare=_adapt), SC.SourceSpec(corpus + "-missing")]
    first = C.run(spark, specs, signal=SIGNAL, stage_root=root)
    again, jobs = _jobs(spark, lambda: C.run(spark, specs, signal=SIGNAL, stage_root=root))
    assert not first.reused and again.reused and jobs == 0
    assert again.skipped == first.skipped and len(again.skipped) == 1
    assert again.prepared.schema == first.prepared.schema and again.prepared.count() == 40
    assert sorted(again.prepared.collect()) == sorted(first.prepared.collect())
    forced = C.run(spark, specs, signal=SIGNAL, stage_root=root, force=True)
    assert not forced.reused and forced.prepared.count() == 40


def test_every_change_is_a_miss(spark, corpus, monkeypatch):
    root = _folder("root")

    def run(signal=SIGNAL, **changed):
        spec = SC.SourceSpec(corpus, **({"prepare": _adapt, "reads": [other]} | changed))
        return C.run(spark, [spec], signal=signal, stage_root=root)

    other = _folder("other") + "/t"
    spark.range(1).write.parquet(other)
    assert not run().reused and run().reused
    # another head (the first 12 rows of 40), then the same as before again
    few = run(head=12)
    assert not few.reused and few.prepared.count() == 12
    assert run().prepared.count() == 40 and run().reused
    assert not run(prepare=_adapt_otherwise).reused and not run(prepare=None).reused
    assert not run(rename={"id": "number"}).reused and not run(keep=["text", "speaker_id", "x"]).reused
    assert not run(signal=C.SignalSpec("x", 8, 8, 0.6)).reused
    monkeypatch.setattr(C, "TEXT_MAX", 28)
    short = run()
    assert not short.reused and short.prepared.count() == 20  # one or two x
    monkeypatch.undo()
    assert run().reused
    spark.range(2).write.mode("append").parquet(other)  # a table that the adapter reads
    assert not run().reused and run().reused
    spark.read.parquet(corpus).limit(5).write.mode("append").parquet(corpus)  # the source itself
    more = run()
    assert not more.reused and more.prepared.count() == 45


def test_helpers_and_constants_of_an_adapter_count(spark):
    names = {"F": F, "LIMIT": 3, "__name__": "made_up"}
    source = "def helper(df):\n    return df.limit(LIMIT)\ndef adapt(df):\n    return helper(df)\n"

    def digest(text, **changed):
        scope = names | changed
        exec(compile(text, "made_up.py", "exec"), scope)
        return ID.code_digest(scope["adapt"])

    same = digest(source)
    assert digest(source) == same
    assert digest(source, LIMIT=4) != same
    assert digest(source.replace("limit(LIMIT)", "limit(LIMIT + 1)")) != same
    one, two = (lambda k: lambda df: df.where(F.col("a") > k))(1), (lambda k: lambda df: df.where(F.col("a") > k))(2)
    assert ID.code_digest(one) != ID.code_digest(two)


def test_frames_in_closures_count(spark, corpus):
    def digest(df):
        return ID.code_digest(lambda: df)

    other = _folder("other") + "/t"
    spark.read.parquet(corpus).write.parquet(other)
    assert digest(spark.read.parquet(corpus)) == digest(spark.read.parquet(corpus))
    assert digest(spark.read.parquet(corpus)) != digest(spark.read.parquet(other))
    assert digest(spark.read.parquet(corpus).where("id > 1")) != digest(spark.read.parquet(corpus).where("id > 2"))
    # rows that the plan does not show
    assert digest(spark.createDataFrame([(1,)], "a int")) != digest(spark.createDataFrame([(1,)], "a int"))


def test_files_are_listed_whatever_the_listing_looks_like(spark, corpus, monkeypatch):
    import re

    same = ID.files_digest(spark, corpus)
    assert same == ID.files_digest(spark, [corpus]) and same != ID.files_digest(spark, f"{corpus}/part-00000*")
    assert ID.files_digest(spark, corpus + "-none") is None
    monkeypatch.setattr(ID, "LISTED", re.compile("(never)(never)(never)(never)"))
    one_by_one = ID.files_digest(spark, corpus)
    assert one_by_one is not None
    spark.range(1).write.mode("append").parquet(corpus)
    assert ID.files_digest(spark, corpus) != one_by_one
    monkeypatch.undo()
    assert ID.files_digest(spark, corpus) != same


def test_digests_are_the_same_in_another_process():
    program = ("import sys; sys.path.insert(0, '.'); from parlance.sources.identity import code_digest;"
               " from parlance.plans import voices, enhanced;"
               " print(code_digest(voices.cleaned_clips, enhanced.run, voices.SignalSpec('x', 8)))")
    seen = {subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True, cwd=os.path.dirname(
        os.path.dirname(os.path.abspath(__file__))), env=os.environ | {"PYTHONHASHSEED": seed}).stdout for seed in ("1", "2")}
    assert len(seen) == 1


def test_a_failed_rebuild_leaves_the_old_stage(spark):
    root = _folder("root")
    made = ST.stage(spark, "s", lambda: spark.range(5), root)

    def fails():
        raise ValueError("no")

    def fails_late():
        return spark.range(100).select(F.raise_error(F.lit("late")).cast("long").alias("id"))

    for build in (fails, fails_late):
        with pytest.raises(Exception):
            ST.stage(spark, "s", build, root, force=True)
        assert made.df.count() == 5
        assert ST.stage(spark, "s", fails, root).df.count() == 5


def test_a_forced_build_leaves_readers_alone(spark):
    root = _folder("root")
    old = ST.stage(spark, "s", lambda: spark.range(5), root)
    new = ST.stage(spark, "s", lambda: spark.range(7), root, force=True)
    assert old.path == new.path and old.version != new.version and old.upstream != new.upstream
    assert old.df.count() == 5 and new.df.count() == 7
    assert ST.stage(spark, "s", lambda: spark.range(9), root).df.count() == 7
    assert ST.prune_stages(spark, root) == []  # too young
    assert [p.rsplit("/", 1)[1] for p in ST.prune_stages(spark, root, 0)] == [old.version]
    assert ST.stage(spark, "s", lambda: spark.range(9), root).df.count() == 7


def test_unfinished_versions_do_not_count(spark):
    root = _folder("root")
    made = ST.stage(spark, "s", lambda: spark.range(5), root)
    for name, manifest in (("v-9999999999998-a", None), ("v-9999999999999-b", '{"schema": {"ty')):
        spark.range(3).write.parquet(f"{made.path}/{name}")
        if manifest is not None:
            with open(f"{made.path}/{name}/{ST.MARKER}", "w") as f:
                f.write(manifest)
    again = ST.stage(spark, "s", lambda: spark.range(9), root)
    assert again.reused and again.df.count() == 5


def test_counts_come_with_the_write(spark):
    root = _folder("root")
    built = ST.Built(spark.range(100), {"note": "x"}, {"n": F.count(F.lit(1)), "big": F.count_if(F.col("id") > 89)})
    for where in (root, None):
        made = ST.materialise(spark, "s", lambda: built, where)
        assert made.info == {"note": "x", "n": 100, "big": 10} and made.df.count() == 100
    again, jobs = _jobs(spark, lambda: ST.materialise(spark, "s", lambda: built, root))
    assert again.reused and again.info["big"] == 10 and jobs == 0


def test_a_source_that_can_be_read_again_comes_back(spark, corpus):
    root, shaky = _folder("root"), _folder("shaky")
    with open(f"{shaky}/part-0.parquet", "wb") as f:
        f.write(b"no parquet")
    specs = [SC.SourceSpec(corpus), SC.SourceSpec(shaky)]
    first = C.run(spark, specs, signal=SIGNAL, stage_root=root)
    assert first.prepared.count() == 40 and len(first.skipped) == 1
    assert C.run(spark, specs, signal=SIGNAL, stage_root=root).reused  # still broken
    os.remove(f"{shaky}/part-0.parquet")
    assert not C.run(spark, specs, signal=SIGNAL, stage_root=root).reused  # its files differ
    spark.read.parquet(corpus).write.mode("append").parquet(shaky)
    both = C.run(spark, specs, signal=SIGNAL, stage_root=root)
    assert not both.reused and both.prepared.count() == 80 and both.skipped == []


def test_a_source_whose_files_did_not_change_but_can_be_read_now(spark, corpus, monkeypatch):
    """Unreadable for a while (a store that did not answer): the same files."""
    root, other = _folder("root"), _folder("other") + "/t"
    spark.read.parquet(corpus).write.parquet(other)
    specs, check = [SC.SourceSpec(corpus), SC.SourceSpec(other)], SC.check_files

    def no_answer(spark, spec):
        if spec.path == other:
            raise SC.BrokenSource("no answer")
        check(spark, spec)

    monkeypatch.setattr(SC, "check_files", no_answer)
    assert C.run(spark, specs, signal=SIGNAL, stage_root=root).prepared.count() == 40
    monkeypatch.undo()
    back = C.run(spark, specs, signal=SIGNAL, stage_root=root)
    assert not back.reused and back.prepared.count() == 80
    assert C.run(spark, specs, signal=SIGNAL, stage_root=root).prepared.count() == 80


def test_a_broken_third_file_is_named(spark, corpus):
    folder = _folder("broken") + "/t"
    spark.read.parquet(corpus).repartition(4).write.parquet(folder)
    spark.read.parquet(corpus).where("false").repartition(1).write.mode("append").parquet(folder)  # a file without rows
    SC.check_files(spark, SC.SourceSpec(folder))
    third = sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))[2]
    with open(f"{folder}/{third}", "r+b") as f:
        f.truncate(os.path.getsize(f"{folder}/{third}") - 20)
    os.remove(f"{folder}/.{third}.crc")
    for spec in (SC.SourceSpec(folder), SC.SourceSpec(folder, head=3), SC.SourceSpec(folder, schema="text string")):
        df, skipped = SC.load_sources(spark, [spec, SC.SourceSpec(corpus)])
        assert len(skipped) == 1 and third in skipped[0]
        assert df.where("source_no = 0").count() == 0 and df.count() == 40


def test_enhanced_stages_and_funnel_without_a_job(spark, corpus):
    root, specs = _folder("root"), [SC.SourceSpec(corpus, prepare=lambda df: df.withColumnRenamed("id", "uid"))]
    vocab = spark.createDataFrame([("a",)], "ch string")

    def run():
        return B.run(spark, specs, vocab, "uid", signal=B.SignalSpec("x", 8, 0.5, 4), with_batches=False, stage_root=root)

    first = run()
    again, jobs = _jobs(spark, run)
    assert jobs == 0 and again.funnel.collect() == first.funnel.collect()
    assert [r["n_rows"] for r in again.funnel.orderBy("stage_no").collect()] == [40] * 5
    assert again.rejects.count() == 0


def test_rows_without_a_signal_are_rejects(spark, corpus):
    specs = [SC.SourceSpec(corpus, prepare=lambda df: df.withColumnRenamed("id", "uid")
                           .withColumn("x", F.when(F.col("uid") % 4 > 0, F.col("x"))))]
    made = C.run(spark, specs, signal=SIGNAL)
    assert made.prepared.count() == 30
    assert {(r["uid"], r["reject_reason"]) for r in made.rejects.collect()} == {(k, "no_result") for k in range(0, 40, 4)}
    vocab = spark.createDataFrame([("a",)], "ch string")
    b = B.run(spark, specs, vocab, "uid", signal=B.SignalSpec("x", 8, 0.5, 4), with_batches=False)
    assert {(r["uid"], r["reject_reason"]) for r in b.rejects.collect()} == {(k, "no_result") for k in range(0, 40, 4)}
    assert b.funnel.where("stage_no = 0").first()["n_rows"] == 40


def test_signals_in_segments_go_through_the_pipelines(spark, corpus):
    """The same clips, whole and in segments of 7 samples."""
    whole = C.run(spark, [SC.SourceSpec(corpus)], signal=SIGNAL)
    cut = spark.read.parquet(corpus).select(
        "id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.slice("x", k * 7 + 1, 7))).alias("clip_no", "x"))
    segments = SEG.Segments(lambda: cut, "id")
    specs = [SC.SourceSpec(corpus, prepare=lambda df: df.drop("x"))]
    made = C.run(spark, specs, signal=C.SignalSpec(None, 8, 8, 0.5, segments))
    cols = ["id", "text", "duration", "sample_rate", "signal"]
    assert sorted(made.prepared.select(cols).collect()) == sorted(whole.prepared.select(cols).collect())
    top = sorted(made.conditioning.collect())
    assert [r["signal"] for r in top] == [r["signal"] for r in sorted(whole.conditioning.collect())] and len(top) == 15


def test_wide_columns_are_fetched_last(spark, corpus):
    """No sort, exchange or checkpoint before the fetch carries the signal."""
    prepared = C.run(spark, [SC.SourceSpec(corpus)], signal=SIGNAL).prepared
    clips = C.conditioning_clips(prepared, fields=("text", "duration", "signal"))
    plan = clips._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    window = text.index("Window")
    assert text.count("Join") == 2 and "signal" not in text[window:].split("LogicalRDD")[0]
    table = C.voice_table(prepared)
    lines = [x for x in table._jdf.queryExecution().optimizedPlan().toString().split("\n") if "signal" in x]
    assert len(lines) == 3 and "Project" in lines[0]  # the result, and the side that is fetched from
    assert sorted(table.columns) == sorted([*prepared.columns, "clip_rank", "total_duration", "is_conditioning"])
    narrow = C.voice_table(prepared.drop("signal"))
    assert sorted(table.drop("signal").select(narrow.columns).collect()) == sorted(narrow.collect())
    by_id = {r["id"]: r["signal"] for r in prepared.collect()}
    assert all(r["signal"] == by_id[r["id"]] for r in table.collect()) and table.count() == 40
