"""Fixed-rate signals derived from the ``events`` table (FIXTURES.md §2).

A speaker's samples are its ``value``s ordered by ``(ts, event_id)``. They
are cut into clips of at most ``max_samples`` consecutive samples, so no
clip, and no aggregation group, grows with the data: a user with a third of
all events becomes many clips. Sample numbers come from
``ordinal.sequence``, which spreads a hot user over many tasks. With the
default ``max_samples`` (the longest clip any pipeline keeps) every test
user is one clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import sequence
from .proxies import table_path

#: longest clip: 15 s at 22 050 Hz (the voices pipeline's cut)
MAX_SAMPLES = 15 * 22050


def signals_from_events(events: DataFrame, max_samples: int = MAX_SAMPLES,
                        rate: int = 16000) -> DataFrame:
    """One row per clip: speaker_id (string), clip_no, x array<double>,
    rate, n_samples. Clip order inside a speaker follows time."""
    ev = events.select(F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("value").cast("double"))
    numbered = sequence(ev, ["ts", "event_id"], keys=["user_id"], name="_sample_no")
    clipped = numbered.withColumn("clip_no", F.floor((F.col("_sample_no") - 1) / F.lit(max_samples)).cast("long"))
    clips = clipped.groupBy("user_id", "clip_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_sample_no"), F.col("value")))).alias("_s"))
    return clips.select(F.col("user_id").cast("string").alias("speaker_id"), "clip_no",
                        F.transform("_s", lambda s: s["value"]).alias("x"),
                        F.lit(rate).alias("rate"),
                        F.size("_s").cast("long").alias("n_samples"))


def event_signals(spark: SparkSession, sf_dir: str, max_samples: int = MAX_SAMPLES,
                  rate: int = 16000) -> DataFrame:
    return signals_from_events(spark.read.parquet(table_path(sf_dir, "events")), max_samples, rate)



def signals_sql(max_samples: int = MAX_SAMPLES, rate: int = 16000) -> str:
    """DuckDB spelling of :func:`signals_from_events` (for the oracle)."""
    return (f"SELECT CAST(user_id AS VARCHAR) AS speaker_id, clip_no, list(value ORDER BY seq) AS x,"
            f" {rate} AS rate, CAST(count(*) AS BIGINT) AS n_samples FROM ("
            f"SELECT user_id, CAST(value AS DOUBLE) AS value, seq, CAST((seq - 1) // {max_samples} AS BIGINT) AS clip_no FROM ("
            f"SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events))"
            f" GROUP BY user_id, clip_no")
