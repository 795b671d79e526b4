"""Per-speaker export of the selected clips.

The input is the bounded conditioning set (k clips per speaker), one row per
clip numbered from 0 in rank order. Two layouts:

* ``folders`` (the reference's): one folder per speaker. The folder name is
  a quoted form of the speaker, so that a null speaker, an empty one and one
  with a slash stay apart; the speaker itself is a column of the files.
* ``buckets``: ``n`` folders by a hash of the speaker. A folder per speaker
  is a file per speaker, which for millions of speakers no file system
  likes; a reader finds a speaker by its bucket and a filter.

Rows are clustered by folder before the write, so each folder gets one file;
a folder of k clips, or a bucket of about rows / n, is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "voice"


def folder_key(speaker: Column) -> Column:
    """A name for a speaker's folder: ``v_`` and the URL-quoted speaker; for
    a null speaker ``none``, which no quoted name equals."""
    return F.coalesce(F.concat(F.lit("v_"), F.url_encode(speaker.cast("string"))), F.lit("none"))


def write_voices(df: DataFrame, path: str, speaker_col: str = "speaker_id", rank_col: str = "clip_rank",
                 fields: Sequence[str] = ("text",), fmt: str = "parquet", buckets: int | None = None) -> None:
    """Write ``fields`` (text, duration, signal, ...) of every clip. With
    ``buckets`` the folders are hash buckets instead of speakers."""
    key = folder_key(F.col(speaker_col)) if buckets is None else F.pmod(F.xxhash64(speaker_col), F.lit(buckets))
    out = df.select(F.col(speaker_col), (F.col(rank_col) - 1).cast("int").alias("clip_no"),
                    *[F.col(f) for f in fields], key.cast("string").alias(FOLDER))
    (out.repartition(FOLDER).sortWithinPartitions(FOLDER, speaker_col, "clip_no")
        .write.mode("overwrite").partitionBy(FOLDER).format(fmt).save(path))


def read_voices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read an export back, without the folder column."""
    return spark.read.format(fmt).load(path).drop(FOLDER)
