"""Enhanced pipeline (entry 2 of the reference, "B"): two sources.

    sources (head of each, renamed, pruned; skipped when unreadable;
    fallback source in full when none loads) (S1-S3, P1, P2, U1)
      -> normalise text (T10) -> quality filter (F5) with reasons and funnel
      -> clean signal (N8 B), at least 0.5 s (F8), rejects (F9)
      -> speaker vector scaled to length one (N10)
      -> encode characters (T13), at most 250 tokens, then < 300 (F7)
      -> seeded split, 15 % test, seed 42 (R2) -> padded batches (K1)

The duration that the quality filter tests is the unprocessed signal's.
Signals of rows that the quality filter rejects are not touched.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal as N
from ..functions.predicates import (
    duration_between, min_samples, not_blank, special_at_most, text_len_between, token_len_below)
from ..functions.text import normalize_text_b
from ..operators import batches as KB
from ..operators import encode as EN
from ..operators import quality as Q
from ..operators import split as SPL
from ..operators.segments import Segments, chain_b, with_clean_segments, with_lengths
from ..sources.corpus import SourceSpec, load_sources, source_identity, still_skipped
from ..sources.identity import code_digest, files_digest
from ..sources.stages import Built, materialise

MAX_TOKENS_PREPARE = 250
MAX_TOKENS_FINAL = 300
TEST_FRACTION = 0.15
SEED = 42


@dataclass(frozen=True)
class SignalSpec:
    """Where a corpus has its signal, already at ``rate`` (a column, or a
    table of segments for signals too long for a row), and how to clean it:
    the cut-off of the high-pass filter, and the fewest samples kept."""
    column: str | None
    rate: int = N.RATE_B
    fc: float = N.HIGHPASS_B
    min_samples: int = N.MIN_SAMPLES_B
    segments: Segments | None = None

    @property
    def seen(self) -> str:
        """The column that is null for a row without a signal."""
        return self.column if self.segments is None else "n_samples"


@dataclass
class EnhancedResult:
    skipped: list
    funnel: DataFrame
    rejects: DataFrame
    batches: DataFrame | None


def run(spark: SparkSession, specs: Sequence[SourceSpec], reference_vocab: DataFrame, key: str,
        fallback: SourceSpec | None = None, labels: Column | None = None, batch_size: int = 8,
        exact_split: bool = False, with_batches: bool = True, signal: SignalSpec | None = None,
        vector_col: str | None = None, stage_root: str | None = None, force: bool = False) -> EnhancedResult:
    """``signal`` cleans the named column into ``signal``; ``vector_col`` is
    scaled to length one and stacked into the batches. The normalised and
    the cleaned rows are stages (S4). With ``stage_root`` they are kept there
    and reused, without a job, by later runs whose sources (their files,
    adapters and what these read), signal and code are the same, unless
    ``force``d; else they are checkpoints of this run. The funnel is counted
    while the first is written."""
    tests = [("text_length", text_len_between("text", Q.TEXT_MIN_B, Q.TEXT_MAX_B)),
             ("duration", duration_between("duration", Q.DURATION_MIN_B, Q.DURATION_MAX_B)),
             ("not_blank", not_blank("text")),
             ("special_chars", special_at_most("text", Q.SPECIAL_MAX_B))]

    def texts() -> Built:
        corpus, skipped = load_sources(spark, specs, fallback)
        if signal is not None and signal.segments is not None:
            corpus = with_lengths(corpus, signal.segments) \
                .withColumn("duration", F.col("n_samples") / F.lit(float(signal.rate)))
        elif signal is not None:
            corpus = corpus.withColumn("duration", N.duration(signal.column, signal.rate))
        # One pass normalises; funnel, reasons and all that follows read the result.
        corpus = corpus.withColumn("text", normalize_text_b("text"))
        return Built(corpus, {"skipped": skipped}, Q.funnel_counts(tests))

    params = {} if stage_root is None else {
        "sources": [source_identity(spark, s) for s in [*specs, *([fallback] if fallback else [])]],
        "segments": [[p, files_digest(spark, p)] for p in (signal.segments.reads if signal and signal.segments else ())],
        "code": code_digest(signal, normalize_text_b, N.duration, Q.reject_reason_b, run)}
    made = materialise(spark, "enhanced-text", texts, stage_root, params, force=force,
                       accept=lambda info: still_skipped(spark, specs, info["skipped"]))
    corpus, skipped = made.df, made.info["skipped"]
    funnel = Q.funnel_rows(spark, tests, made.info)
    kept, rejects = Q.split_rejects(Q.with_reject_reason(corpus, signal_col=signal.seen if signal else None))
    rejects = rejects.select(key, "reject_reason")
    kept = kept.drop("reject_reason")
    if signal is not None:
        def signals() -> Built:
            if signal.segments is not None:
                clean = with_clean_segments(kept, signal.segments, chain_b(signal.rate, signal.fc), "_clean")
            else:
                clean = N.with_clean_signal_b(kept, signal.column, "_clean", signal.rate, fc=signal.fc).drop(signal.column)
            clean = Q.prepare_or_reject(clean, F.col("_clean"), [
                (~min_samples("_clean", signal.min_samples), "too_short")], "signal").drop("_clean")
            return Built(clean)
        made = materialise(spark, "enhanced-signals", signals, stage_root,
                           {"code": code_digest(N.with_clean_signal_b, with_clean_segments, Q.prepare_or_reject, signals)},
                           made.upstream, force)
        kept, unusable = Q.split_rejects(made.df)
        rejects = rejects.union(unusable.select(key, "reject_reason"))
    if not with_batches:
        return EnhancedResult(skipped, funnel, rejects, None)

    enc = EN.encode_chars(kept, "text", EN.vocab_ids(reference_vocab))
    enc = enc.where(token_len_below("input_ids", MAX_TOKENS_PREPARE + 1))
    enc = enc.where(token_len_below("input_ids", MAX_TOKENS_FINAL))  # redundant, kept as in the reference
    more = ["signal"] if signal is not None else []
    if labels is not None:
        enc, more = enc.withColumn("labels", labels), [*more, "labels"]
    if vector_col is not None:
        enc = enc.withColumn("speaker_embedding", N.l2_normalize(vector_col))
        more = [*more, "speaker_embedding"]
    split_marked, _ = SPL.assign_split(enc, TEST_FRACTION, key, SEED, exact=exact_split)
    cols = [key, "speaker_id", "source_no", "pos", "input_ids", *more]
    sided = split_marked.select(*cols, F.when(F.col("is_test"), F.lit("test")).otherwise(F.lit("train")).alias("split"))
    batches = KB.pad_batches(sided, batch_size, ["source_no", "pos"],
                             labels_col="labels" if labels is not None else None, groups=["split"])
    return EnhancedResult(skipped, funnel, rejects, batches)
