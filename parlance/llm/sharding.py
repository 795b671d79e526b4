"""Operator 8, sharding by bytes: every document gets a place in one global
order, the running sum of sizes before it, and the shard whose equal byte
target that sum falls into, so shards are contiguous and balanced.

Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, global_prefix, table

FRAME_BYTES = 8


def _placed(docs: DataFrame, n_shards: int, id_col: str, text_col: str, carried: list[Column]) -> DataFrame:
    """(_id, _size, _crc, _shard, _slot) and ``carried`` for every row."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + FRAME_BYTES).alias("_size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("_crc"),
        F.lit(1).cast("long").alias("_one"), *carried)
    order = [F.col("_id").asc_nulls_first(), F.col("_crc"), F.col("_size")]
    placed = global_prefix(scratch, narrow, order, {"_start": "_size", "_row": "_one"})
    total = placed.sparkSession.read.schema(narrow.withColumn("_part", F.lit(0)).schema) \
        .parquet(scratch.path("ranged")).agg(F.sum("_size").alias("_total"))
    # One row: the corpus size.
    placed = placed.crossJoin(F.broadcast(total))
    middle = F.expr(f"((2 * _start + _size) * {n_shards}) div (2 * _total)")
    placed = placed.withColumn("_shard", F.least(F.lit(n_shards - 1), middle).cast("int"))
    placed = scratch.write(placed.drop("_start", "_one", "_total"), "placed")
    # One row per shard.
    first = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "_shard").withColumn("_slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row (``id_col``, size, text_crc32, shard, slot) per row of
    ``docs``.

    size is the UTF-8 length plus ``FRAME_BYTES`` (null text: just those).
    The order is by id (nulls first), then checksum and size. A document
    belongs to the shard in which the middle of its byte range lies, so each
    shard misses its target by at most half a document at either end; one
    document larger than a target may leave shards empty. slot counts from 0
    inside a shard. Rows repeated in full are told apart only by their slot;
    an empty table gives no rows. Other columns of ``docs`` are not read."""
    return _placed(docs, n_shards, id_col, text_col, []).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write ``docs``, all columns, into one folder per shard, in slot order
    inside each file. Rows travel with their place, so repeated and null ids
    do no harm. Folders are named after the shard (``_shard=0``...); a column
    of that name is not allowed."""
    placed = _placed(docs, n_shards, id_col, text_col, [F.struct(*docs.columns).alias("_doc")])
    (placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
           .select("_doc.*", "_shard").write.partitionBy("_shard").parquet(path))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
