"""Corpus frames derived from the driver's test tables (FIXTURES.md §2).

There is no audio and no Italian speech in the test tables, so these are
stand-ins of our own, not the reference's:

* utterances: ``conversations`` rows, speaker := ``role``, duration :=
  length of the raw text / 15 characters per second;
* transcripts: ``documents`` rows, speaker := ``lang``;
* speaker vectors: ``embeddings.embedding`` (64 floats);
* signals: see ``sources.signals``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import read_corpus, read_table

#: characters per second used to give text rows a duration
CHARS_PER_SECOND = 15.0


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def raw_duration(text_col: str = "text") -> F.Column:
    """Duration proxy of an utterance, from its raw (unnormalised) text."""
    return F.length(F.col(text_col)) / F.lit(CHARS_PER_SECOND)


def conversations_corpus(spark: SparkSession, sf_dir: str, source_no: int = 0) -> DataFrame:
    """Utterances: text, speaker_id (= role), duration, conv_id, turn,
    source_no, pos."""
    df = read_corpus(spark, table_path(sf_dir, "conversations"), source_no=source_no)
    return df.select(F.col("text"), F.col("role").alias("speaker_id"),
                     raw_duration("text").alias("duration"),
                     "conv_id", "turn", "source_no", "pos")


def documents_corpus(spark: SparkSession, sf_dir: str, source_no: int = 0) -> DataFrame:
    """Transcripts: text, speaker_id (= lang), doc_id, source, n_chars,
    source_no, pos."""
    df = read_corpus(spark, table_path(sf_dir, "documents"), source_no=source_no)
    return df.select("text", F.col("lang").alias("speaker_id"), "doc_id", "source",
                     "n_chars", "source_no", "pos")


def embeddings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, table_path(sf_dir, "embeddings"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores when it has few splits."""
    return read_table(spark, table_path(sf_dir, name))
