"""Voices pipeline (entry 3 of the reference, "C"): normalise, filter,
keep speakers with enough clips, rank clips per speaker, export.

    sources -> normalise text (T11) -> length 10..200 (F1)
            -> resample (N9) -> clean signal (N8 C, N7) -> rejects (F9)
            -> duration of the cleaned signal 2..15 s (F2)
            -> default speaker (P4) -> record (P6)
            -> gate: >= 100 clips (G11)
            -> speakers with >= 5 clips (G7) -> rank (W1) / top 5 (W2)
            -> totals (G8) -> voice table (G9) -> gate: >= 5 speakers (G11)
            -> per-speaker export (S5); first 3 speakers (W3)

Only rows that pass the text tests have their signals touched. A corpus
without signals uses its ``duration`` column instead, and is filtered by it
before anything is normalised.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal as N
from ..functions.predicates import duration_between, text_len_between
from ..functions.text import normalize_text_c
from ..operators import speakers as spk
from ..operators.quality import prepare_or_reject, split_rejects
from ..operators.segments import Segments, chain_c, with_clean_segments
from ..session import stable
from ..sources.corpus import SourceSpec, default_speaker, load_sources, source_identity, still_skipped
from ..sources.export import write_voices
from ..sources.identity import code_digest, files_digest
from ..sources.stages import Built, materialise

TEXT_MIN, TEXT_MAX = 10, 200
DURATION_MIN, DURATION_MAX = 2.0, 15.0
MIN_CLIPS = 5
TOP_K = 5


def prepare_text(df: DataFrame, text_col: str = "text", duration_col: str = "duration") -> DataFrame:
    """Text half of the voices preparation: the duration test, which does
    not look at the text, then the normaliser on what is left, then the
    length test. The kept rows are checkpointed (the reference caches this
    stage too), so that later branches do not normalise again; the length is
    tested on a column of its own, so that Catalyst does not push the
    normaliser into the filter as well."""
    return stable(normalised_clips(df, text_col, duration_col))


def normalised_clips(df: DataFrame, text_col: str = "text", duration_col: str = "duration") -> DataFrame:
    """:func:`prepare_text` without the checkpoint."""
    return _of_length(df.where(duration_between(duration_col, DURATION_MIN, DURATION_MAX)), text_col)


def _of_length(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose normalised text has the right length. Catalyst would put
    the normaliser into both comparisons and run it three times; a condition
    on a number that is made beside the text keeps the filter above it."""
    made = df.withColumns({text_col: normalize_text_c(text_col), "_made": F.monotonically_increasing_id()})
    return made.where(text_len_between(text_col, TEXT_MIN, TEXT_MAX) & (F.col("_made") >= 0)).drop("_made")


@dataclass(frozen=True)
class SignalSpec:
    """Where a corpus has its signal, and how to clean it: the column, or a
    table of segments (for signals too long for a row), its rate (a number,
    or a column where rows differ; a number for segments), the rate to clean
    at, and the cut-off of the high-pass filter."""
    column: str | None
    rate_in: int | str
    rate: int = N.RATE_C
    fc: float = N.HIGHPASS_C
    segments: Segments | None = None


def cleaned_clips(df: DataFrame, signal: SignalSpec, text_col: str = "text") -> DataFrame:
    """Rows that pass the text test, with ``signal`` (the cleaned one),
    ``sample_rate``, its ``duration`` and ``reject_reason``: null for
    prepared rows, "no_result" for a missing signal, one with a null or
    non-finite sample, or one too short after cleaning, "duration" for one
    outside the bounds."""
    texts = _of_length(df, text_col)
    if signal.segments is not None:
        clean = with_clean_segments(stable(texts), signal.segments, chain_c(signal.rate, signal.fc), "_clean", signal.rate_in)
    else:
        clean = texts.withColumn("_resampled", N.resample(signal.column, signal.rate_in, signal.rate))
        clean = N.with_clean_signal_c(clean, "_resampled", "_clean", signal.rate, fc=signal.fc) \
                 .drop("_resampled", signal.column)
    clean = prepare_or_reject(clean, F.col("_clean"), [
        (~duration_between(N.duration("_clean", signal.rate), DURATION_MIN, DURATION_MAX), "duration")], "signal")
    return clean.drop("_clean").withColumn("duration", N.duration("signal", signal.rate)) \
                .withColumn("sample_rate", F.lit(signal.rate))


def prepare_signals(df: DataFrame, signal: SignalSpec, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(prepared rows, rejects with ``reject_reason``) of
    :func:`cleaned_clips`, written once."""
    kept, rejects = split_rejects(stable(cleaned_clips(df, signal, text_col)))
    return kept.drop("reject_reason"), rejects.drop("signal", "duration", "sample_rate")


def utterance_record() -> Column:
    """The record of a prepared row, with its cleaned signal."""
    return F.struct("text", F.col("signal").alias("audio"), "speaker_id", "duration", "sample_rate")


def conditioning_clips(prepared: DataFrame, k: int = TOP_K, min_clips: int = MIN_CLIPS,
                       fields: tuple[str, ...] = ("text", "duration")) -> DataFrame:
    """Flagship result: for every speaker with at least ``min_clips`` clips,
    its best ``k`` clips (score = length x duration, ties in source order)
    with the speaker's total duration over all its clips. One aggregation
    gives count and total of every speaker; the at most k clips of each meet
    it, so the corpus itself is not joined to anything."""
    wide = spk.wide_columns(prepared.select(*fields))
    if wide:  # ranked without them, fetched for the clips that stay
        keys = ["speaker_id", "source_no", "pos"]
        narrow = conditioning_clips(prepared.drop(*wide), k, min_clips, tuple(f for f in fields if f not in wide))
        return spk.fetch(narrow, prepared, keys, wide).select(
            "speaker_id", "clip_rank", *fields, "total_duration", "source_no", "pos")
    stats = prepared.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("_n"),
                                               F.sum("duration").alias("total_duration"))
    stats = stats.where(F.col("_n") >= min_clips).drop("_n").withColumnRenamed("speaker_id", "_t_spk")
    top = spk.top_clips(prepared, k)
    out = top.join(stats, top["speaker_id"].eqNullSafe(stats["_t_spk"]), "inner").drop("_t_spk")
    return out.select("speaker_id", "clip_rank", *fields, "total_duration", "source_no", "pos")


def voice_table(prepared: DataFrame, k: int = TOP_K, min_clips: int = MIN_CLIPS) -> DataFrame:
    """G9 long form: every clip of every speaker with >= ``min_clips``
    clips, ranked, flagged as conditioning for the best ``k``. Signals are
    fetched at the end, for the clips that stay."""
    wide = spk.wide_columns(prepared)
    good = spk.voice_table(spk.min_rows_per_speaker(prepared.drop(*wide), min_clips), k)
    return spk.fetch(good, prepared, ["speaker_id", "source_no", "pos"], wide) if wide else good


def gates(prepared: DataFrame, min_samples: int = 100, min_speakers: int = 5,
          min_clips: int = MIN_CLIPS) -> DataFrame:
    """The two warnings of the voices pipeline as rows
    (check, value, threshold, ok), from the clip counts of the speakers."""
    counts = spk.speaker_counts(prepared)
    wide = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"),
                      F.count_if(F.col("n") >= min_clips).alias("speakers"))
    out = wide.selectExpr(f"stack(2, 'samples', samples, {min_samples}L, 'speakers', speakers, {min_speakers}L)"
                          " AS (check, value, threshold)")
    return out.withColumn("ok", F.col("value") >= F.col("threshold"))


# --- end to end ---------------------------------------------------------------

@dataclass
class VoicesResult:
    """What a run prepared; each report is planned when it is asked for."""
    skipped: list
    prepared: DataFrame
    rejects: DataFrame | None
    reused: bool
    k: int
    min_clips: int
    fields: tuple[str, ...]

    @cached_property
    def conditioning(self) -> DataFrame:
        return conditioning_clips(self.prepared, self.k, self.min_clips, self.fields)

    @cached_property
    def voices(self) -> DataFrame:
        return voice_table(self.prepared, self.k, self.min_clips)

    @cached_property
    def gates(self) -> DataFrame:
        return gates(self.prepared, min_clips=self.min_clips)

    @cached_property
    def first_speakers(self) -> DataFrame:
        return spk.first_speakers(spk.min_rows_per_speaker(
            self.prepared.select("speaker_id", "source_no", "pos"), self.min_clips), 3)


def run(spark, specs: list[SourceSpec], export_path: str | None = None, k: int = TOP_K,
        min_clips: int = MIN_CLIPS, signal: SignalSpec | None = None, stage_root: str | None = None,
        force: bool = False) -> VoicesResult:
    """Sources -> prepared clips -> ranked voice table -> export. Raises when
    no source loads (the voices pipeline has no fallback).

    The prepared clips and the rejects are one stage (S4). With
    ``stage_root`` it is kept there and reused, without a job, by later runs
    whose sources (their files, adapters and what these read), signal and
    code are the same, unless ``force``d; else it is a checkpoint."""
    def build() -> Built:
        corpus, skipped = load_sources(spark, specs)
        if signal is None:
            rows = normalised_clips(corpus).withColumn("reject_reason", F.lit(None).cast("string"))
        else:
            rows = cleaned_clips(corpus, signal)
        return Built(default_speaker(rows), {"skipped": skipped})

    params = {} if stage_root is None else {
        "sources": [source_identity(spark, s) for s in specs],
        "segments": [[p, files_digest(spark, p)] for p in (signal.segments.reads if signal and signal.segments else ())],
        "code": code_digest(signal, normalised_clips, cleaned_clips, default_speaker)}
    made = materialise(spark, "voices-prepared", build, stage_root, params, force=force,
                       accept=lambda info: still_skipped(spark, specs, info["skipped"]))
    prepared, rejects = split_rejects(made.df)
    fields = ("text", "duration") + (("signal", "sample_rate") if signal is not None else ())
    result = VoicesResult(made.info["skipped"], prepared.drop("reject_reason"),
                          None if signal is None else rejects.drop("signal", "duration", "sample_rate"), made.reused,
                          k, min_clips, fields)
    if export_path is not None:
        write_voices(result.conditioning, export_path, fields=fields)
    return result
