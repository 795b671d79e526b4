"""Quality filters, stage funnel and gates.

The enhanced pipeline's quality filter is one ``where`` over cheap text
tests first; the reason column reports the first failing test in the
reference's order (text length, duration, blank, special characters).
The duration test reads a stored ``duration`` (or ``n_samples``) column,
so the signal array itself is never decoded for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import duration_between, not_blank, special_at_most, text_len_between

# Fixed values of the enhanced pipeline's quality filter.
TEXT_MIN_B, TEXT_MAX_B = 10, 300
DURATION_MIN_B, DURATION_MAX_B = 1.0, 10.0
SPECIAL_MAX_B = 0.3


def reject_reason_b(text_col: str = "text", duration_col: str = "duration",
                    special_max: float = SPECIAL_MAX_B, signal_col: str | None = None) -> Column:
    """First failing test of the enhanced quality filter, or null. With
    ``signal_col``, a row that passes the length test but has no signal to
    take a duration from is "no_result" (the reference's preparation fails
    on it)."""
    t = F.col(text_col)

    def fails(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))  # a null text or duration passes no test

    reason = F.when(fails(text_len_between(t, TEXT_MIN_B, TEXT_MAX_B)), F.lit("text_length"))
    if signal_col is not None:
        reason = reason.when(F.col(signal_col).isNull(), F.lit("no_result"))
    return (reason
             .when(fails(duration_between(duration_col, DURATION_MIN_B, DURATION_MAX_B)), F.lit("duration"))
             .when(fails(not_blank(t)), F.lit("blank"))
             .when(fails(special_at_most(t, special_max)), F.lit("special_chars")))


def quality_filter_b(df: DataFrame, text_col: str = "text", duration_col: str = "duration",
                     special_max: float = SPECIAL_MAX_B) -> DataFrame:
    """keep rows passing length 10..300, duration 1..10 s, not blank and
    special ratio <= 0.3."""
    t = F.col(text_col)
    cond = (text_len_between(t, TEXT_MIN_B, TEXT_MAX_B)
            & duration_between(duration_col, DURATION_MIN_B, DURATION_MAX_B)
            & not_blank(t) & special_at_most(t, special_max))
    return df.where(cond)


def with_reject_reason(df: DataFrame, text_col: str = "text", duration_col: str = "duration",
                       special_max: float = SPECIAL_MAX_B, signal_col: str | None = None) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason_b(text_col, duration_col, special_max, signal_col))


def prepare_or_reject(df: DataFrame, prepared: Column, reasons: Sequence[tuple[Column, str]],
                      out_col: str = "prepared") -> DataFrame:
    """apply a preparation that may yield nothing; rows whose result is
    null, or that fail one of ``reasons`` (a list of (failed condition,
    label) in test order), get a ``reject_reason``. Split with
    :func:`split_rejects`."""
    out = df.withColumn(out_col, prepared)
    reason = F.lit(None).cast("string")
    for cond, label in reversed(list(reasons)):
        reason = F.when(cond, F.lit(label)).otherwise(reason)
    reason = F.when(F.col(out_col).isNull(), F.lit("no_result")).otherwise(reason)
    return out.withColumn("reject_reason", reason)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows) from a frame with ``reject_reason``."""
    return df.where(F.col("reject_reason").isNull()), df.where(F.col("reject_reason").isNotNull())


def funnel_counts(stages: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """The aggregates of :func:`funnel` by name (``n0`` the input, ``nk`` the
    rows that pass conditions 1..k), for an observation or an ``agg``."""
    passed = F.lit(True)
    counts = {"n0": F.count(F.lit(1))}
    for i, (_, cond) in enumerate(stages, start=1):
        passed = passed & F.coalesce(cond, F.lit(False))
        counts[f"n{i}"] = F.count_if(passed)
    return counts


def _funnel_names(stages: Sequence[tuple[str, Column]]) -> list[str]:
    return ["input", *[n for n, _ in stages]]


def funnel_rows(spark: SparkSession, stages: Sequence[tuple[str, Column]], counts: dict) -> DataFrame:
    """The funnel from counts that were observed while a stage was written."""
    return spark.createDataFrame([(i, n, int(counts[f"n{i}"])) for i, n in enumerate(_funnel_names(stages))],
                                 "stage_no int, stage string, n_rows long")


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each stage, in one pass. ``stages`` is a list
    of (name, condition); stage k keeps rows passing conditions 1..k.
    Result: one row per stage (stage_no, stage, n_rows)."""
    wide = df.agg(*[c.alias(n) for n, c in funnel_counts(stages).items()])
    names = _funnel_names(stages)
    pairs = ", ".join(f"{i}, '{n}', n{i}" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {pairs}) AS (stage_no, stage, n_rows)") \
               .select(F.col("stage_no").cast("int"), "stage", F.col("n_rows").cast("long"))
