"""Speaker statistics, speaker filters and clip ranking (G1-G9, J1/F6,
W1-W3, U2).

A null speaker is an ordinary group (the reference keys a dict by it), so
every join back to per-speaker results is null-safe (``eqNullSafe``); a
plain ``on="speaker_id"`` join would silently drop the null group.

Scale notes
* Counts and sums are hash aggregations with map-side partial aggregation,
  so a hot speaker costs one partial row per map task.
* Per-speaker tables are joined back with a null-safe equi-join; AQE turns
  it into a broadcast join when the measured table is small and otherwise
  keeps a sort-merge join with skew splitting.
* Top-k per speaker uses ``row_number() <= k``, which Catalyst plans as a
  partial ``WindowGroupLimit`` before the shuffle: at most k rows per
  speaker per map task cross the network.
* Full ranking inside a speaker uses :func:`ordinal.sequence`, which range
  partitions so a hot speaker is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from .ordinal import sequence

SPK = "speaker_id"


def _semi_null_safe(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    k = keys.select(F.col(col).alias("_spk_key"))
    return df.join(k, df[col].eqNullSafe(k["_spk_key"]), "left_semi")


# --- G1, G2, U2: vocabulary -------------------------------------------------

def char_vocab(df: DataFrame, text_col: str = "text") -> DataFrame:
    """G1: distinct characters of all texts (code points). The reference
    joins the texts with spaces before taking the set, so a space is a
    member whenever there are at least two rows. Every text gives its
    distinct characters only, so what is exploded and aggregated is some
    dozens of rows a text however long it is."""
    chars = (df.select(F.explode(F.array_distinct(F.split(F.coalesce(F.col(text_col), F.lit("")), ""))).alias("ch"))
               .where(F.length("ch") > 0))
    # "at least two rows" needs two rows, not a count of the table
    joiner = (df.limit(2).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= 2).select(F.lit(" ").alias("ch")))
    return chars.unionByName(joiner).distinct()


def vocab_sizes(vocab: DataFrame, reference_vocab: DataFrame) -> DataFrame:
    """Sizes of the corpus vocabulary and of the reference vocabulary."""
    a = vocab.select(F.lit(1).alias("_in_ds"), F.lit(0).alias("_in_ref"))
    b = reference_vocab.select(F.lit(0).alias("_in_ds"), F.lit(1).alias("_in_ref"))
    return a.unionByName(b).agg(F.sum("_in_ds").cast("long").alias("dataset_vocab_size"),
                                F.sum("_in_ref").cast("long").alias("reference_vocab_size"))


def missing_chars(vocab: DataFrame, reference_vocab: DataFrame) -> DataFrame:
    """Corpus characters absent from the reference vocabulary."""
    ref = reference_vocab.select(F.col("ch").alias("_ref_ch"))
    return vocab.join(ref, vocab["ch"] == ref["_ref_ch"], "left_anti")


# --- G3-G6, F6/J1, G7: counts and bands ---------------------------------------

def speaker_counts(df: DataFrame, speaker_col: str = SPK) -> DataFrame:
    """Rows per speaker (null is a group)."""
    return df.groupBy(speaker_col).agg(F.count(F.lit(1)).alias("n"))


def speaker_summary(counts: DataFrame) -> DataFrame:
    """Number of speakers and mean rows per speaker (null on an empty
    table instead of a division by zero)."""
    return counts.agg(F.count(F.lit(1)).alias("n_speakers"),
                      F.sum("n").alias("n_rows"),
                      (F.sum("n") / F.count(F.lit(1))).alias("mean_rows_per_speaker"))


def count_histogram(counts: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of per-speaker row counts, ``bins`` equal bins over
    [min, max]; the last bin is closed; empty bins are reported with 0.
    When min == max the range is widened by 0.5 on each side. The range is
    two scalars fetched to the driver; the binning is a distributed
    aggregation."""
    lo, hi = counts.agg(F.min("n"), F.max("n")).first()
    spark = counts.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n_speakers long")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("n") - F.lit(lo)) / F.lit(width)).cast("int") + 1, F.lit(bins))
    filled = counts.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_speakers"))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin",
                         (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lower"),
                         (F.lit(lo) + F.col("bin") * F.lit(width)).alias("upper"))
    return (edges.join(F.broadcast(filled), "bin", "left")
                 .select("bin", "lower", "upper",
                         F.coalesce("n_speakers", F.lit(0)).cast("long").alias("n_speakers")))


def speaker_band(df: DataFrame, lo: int = 100, hi: int = 400, speaker_col: str = SPK) -> DataFrame:
    """F6 via J1: keep rows whose speaker has ``lo..hi`` rows (inclusive).
    The per-speaker table is semi-joined null-safely."""
    good = speaker_counts(df, speaker_col).where(F.col("n").between(lo, hi))
    return _semi_null_safe(df, good, speaker_col)


def band_summary(df: DataFrame, speaker_col: str = SPK) -> DataFrame:
    """Rows and distinct speakers (a null speaker counts as one)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  (F.count_distinct(F.col(speaker_col))
                   + F.max(F.col(speaker_col).isNull().cast("int")).cast("long")).alias("n_speakers"))


def min_rows_per_speaker(df: DataFrame, n: int = 5, speaker_col: str = SPK) -> DataFrame:
    """Keep rows of speakers with at least ``n`` rows (HAVING)."""
    good = speaker_counts(df, speaker_col).where(F.col("n") >= n)
    return _semi_null_safe(df, good, speaker_col)


# --- W1-W3, G8, G9: ranking ---------------------------------------------------

def clip_score(text_col: str = "text", duration_col: str = "duration") -> Column:
    """Quality score of the voices pipeline: text length x duration."""
    return F.length(F.col(text_col)) * F.col(duration_col)


def wide_columns(df: DataFrame) -> list[str]:
    """The columns that may hold a signal or another long value, which
    sorts and exchanges should not carry along."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType, BinaryType))]


def fetch(narrow: DataFrame, df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``narrow`` with the columns ``cols`` of the rows of ``df`` that it has
    by ``keys``, which tell the rows of ``df`` apart (null equals null).
    With few rows in ``narrow`` AQE broadcasts them, and the others of
    ``df`` are read but not moved."""
    own = {k: f"_fetch_{i}" for i, k in enumerate(keys)}
    right = df.select(*[F.col(k).alias(own[k]) for k in keys], *cols)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(own[k]))
    return narrow.join(right, same).drop(*own.values())


def rank_clips(df: DataFrame, speaker_col: str = SPK, score: Column | None = None,
               order_cols=("source_no", "pos"), name: str = "clip_rank") -> DataFrame:
    """1-based rank of every clip inside its speaker by score
    descending; ties keep source order (Python's sort is stable). Exact and
    skew-safe (range partitioned, see ``ordinal.sequence``). Where ``df``
    has wide columns only speaker, score and ``order_cols`` (which tell the
    clips of a speaker apart) are sorted, and the rest is fetched by them."""
    score = clip_score() if score is None else score
    wide = wide_columns(df)
    keys = [speaker_col, *order_cols]
    scored = (df.select(*keys, score.alias("_score")) if wide else df.withColumn("_score", score))
    out = sequence(scored, [F.col("_score").desc_nulls_last()] + [F.col(c).asc() for c in order_cols],
                   keys=[speaker_col], name=name).drop("_score")
    if not wide:
        return out
    return fetch(out, df, keys, [c for c in df.columns if c not in keys]).select(*df.columns, name)


def top_clips(df: DataFrame, k: int = 5, speaker_col: str = SPK, score: Column | None = None,
              order_cols=("source_no", "pos"), name: str = "clip_rank") -> DataFrame:
    """The best ``k`` clips per speaker (fewer if it has fewer), with
    their rank. Planned as partial + final ``WindowGroupLimit``; wide columns
    are fetched for the clips that stay, as in :func:`rank_clips`."""
    score = clip_score() if score is None else score
    wide, keys = wide_columns(df), [speaker_col, *order_cols]
    w = Window.partitionBy(speaker_col).orderBy(
        *([F.col("_score").desc_nulls_last()] + [F.col(c).asc() for c in order_cols]))
    scored = df.select(*keys, score.alias("_score")) if wide else df.withColumn("_score", score)
    top = scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k) \
                .withColumn(name, F.col(name).cast("long")).drop("_score")
    if not wide:
        return top
    return fetch(top, df, keys, [c for c in df.columns if c not in keys]).select(*df.columns, name)


def total_duration(df: DataFrame, speaker_col: str = SPK, duration_col: str = "duration") -> DataFrame:
    """Total duration per speaker."""
    return df.groupBy(speaker_col).agg(F.sum(duration_col).alias("total_duration"))


def voice_table(df: DataFrame, k: int = 5, speaker_col: str = SPK, score: Column | None = None,
                order_cols=("source_no", "pos")) -> DataFrame:
    """G9 in long form: one row per clip with its rank inside the speaker,
    ``is_conditioning`` for the best ``k`` (they also stay training clips)
    and the speaker's total duration. Nothing is collected per speaker."""
    wide, keys = wide_columns(df), [speaker_col, *order_cols]
    ranked = rank_clips(df.drop(*wide), speaker_col, score, order_cols)
    # totals from the ranked rows (read from the ranking's checkpoint)
    totals = total_duration(ranked, speaker_col).withColumnRenamed(speaker_col, "_tot_spk")
    out = ranked.join(totals, ranked[speaker_col].eqNullSafe(totals["_tot_spk"]), "inner").drop("_tot_spk")
    if wide:  # last, so that nothing before it carries them
        out = fetch(out, df, keys, wide)
    return out.withColumn("is_conditioning", F.col("clip_rank") <= k)


def conditioning_table(df: DataFrame, k: int = 5, speaker_col: str = SPK, score: Column | None = None,
                       order_cols=("source_no", "pos"), fields=("text", "duration")) -> DataFrame:
    """G9 nested form, bounded: one row per speaker with its best ``k``
    clips (narrow fields only) as a sorted array, plus clip count and total
    duration. Only k entries per speaker are ever gathered."""
    top = top_clips(df, k, speaker_col, score, order_cols)
    nested = top.groupBy(speaker_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("clip_rank"), *[F.col(f) for f in fields])))
         .alias("conditioning_samples"))
    stats = df.groupBy(speaker_col).agg(F.count(F.lit(1)).alias("n_clips"),
                                        F.sum("duration").alias("total_duration"))
    stats = stats.withColumnRenamed(speaker_col, "_st_spk")
    return nested.join(stats, nested[speaker_col].eqNullSafe(stats["_st_spk"])).drop("_st_spk")


def first_speakers(df: DataFrame, k: int = 3, speaker_col: str = SPK,
                   order_cols=("source_no", "pos")) -> DataFrame:
    """The first ``k`` speakers in order of first appearance."""
    first = df.groupBy(speaker_col).agg(
        F.min(F.struct(*[F.col(c) for c in order_cols])).alias("_first"))
    return (first.orderBy("_first").limit(k)
                 .select(speaker_col, *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order_cols]))
