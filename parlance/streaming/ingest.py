"""Incremental preparation of newly arriving corpus files.

The reference has no streams. Its row-local stages (text normalisation,
quality filter with reasons) are stateless, so they run unchanged on a
Structured Streaming DataFrame: new parquet files in a folder are
normalised and filtered as they land, with exactly-once output through the
sink's checkpoint. Grouping stages (speaker counts, ranking) stay batch jobs
over the accumulated output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import normalize_text_b, normalize_text_c
from ..operators.quality import with_reject_reason


def prepare_stream(stream: DataFrame, normalizer: str = "b", text_col: str = "text",
                   duration_col: str = "duration") -> DataFrame:
    """Row-local preparation of a streaming (or batch) frame with a duration
    column: normalised text, and the enhanced filter's reject reason."""
    norm = normalize_text_b if normalizer == "b" else normalize_text_c
    return with_reject_reason(stream.withColumn(text_col, norm(text_col)), text_col, duration_col)


def start_ingest(spark: SparkSession, source_glob: str, schema: StructType | str, sink_dir: str,
                 checkpoint_dir: str, normalizer: str = "b", available_now: bool = True,
                 max_files_per_trigger: int = 64) -> StreamingQuery:
    """Watch ``source_glob`` for parquet files and append prepared rows to
    ``sink_dir`` (parquet). ``checkpoint_dir`` must be on shared storage on a
    cluster. With ``available_now`` the query processes what is there and
    stops (batch-like, restartable)."""
    stream = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_glob))
    writer = (prepare_stream(stream, normalizer).writeStream
              .format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
