"""Exact row numbering that does not put a hot group into one task.

``row_number().over(Window.partitionBy(k).orderBy(o))`` hashes every row of
a key to one task; when one speaker holds a third of the corpus that task
sorts a third of the corpus. Here the rows are range-partitioned on
``(k, o)`` instead, so a hot key is spread over many partitions, and each
row's number is

    rows of the same key in earlier partitions        (small offset table)
  + its index inside its partition run of that key    (from a sorted scan)

The offset table has at most ``#groups + #partitions`` rows. The
range-partitioned frame is checkpointed once, so partition ids and
per-partition indexes are fixed before they are read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

TARGET_PARTITION_BYTES = 128 << 20
# Spark gives a relation whose size it does not know a size of this order.
UNKNOWN_BYTES = 1 << 60


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def target_partitions(df: DataFrame) -> int:
    """Partitions for a full shuffle of ``df``: about
    ``TARGET_PARTITION_BYTES`` of what its plan reads each, never fewer than
    the cluster's cores (so a hot key still spreads); planning only, no job.
    The sizes are those of the plan's leaves: estimates further up multiply
    at every join. A checkpoint carries such an estimate along, so of it, and
    of a local RDD, the number of partitions counts instead."""
    floor = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        size = int(str(leaf.stats().sizeInBytes()))
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            floor = max(floor, leaf.rdd().getNumPartitions())
        elif size < UNKNOWN_BYTES:
            known += size
    return max(floor, -(-known // TARGET_PARTITION_BYTES))


def sequence(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (),
             name: str = "seq", partitions: int | None = None) -> DataFrame:
    """Add ``name``: 1-based position of each row by ``order`` inside its
    ``keys`` group (whole frame when ``keys`` is empty).

    ``order`` must be a total order inside a group (end it with a unique
    column); null keys form one group, as in a Python dict."""
    n = partitions or target_partitions(df)
    keys = list(keys)
    key_sort = [F.col(k).asc_nulls_first() for k in keys]
    sort = key_sort + [_as_col(o) for o in order]
    ranged = (df.repartitionByRange(n, *sort)
                .sortWithinPartitions(*sort)
                .withColumn("_seq_part", F.spark_partition_id())
                .withColumn("_seq_mid", F.monotonically_increasing_id()))
    ranged = stable(ranged)

    renamed = [F.col(k).alias(f"_seq_k{i}") for i, k in enumerate(keys)]
    runs = (ranged.groupBy(F.col("_seq_part"), *renamed)
                  .agg(F.count(F.lit(1)).alias("_seq_n"), F.min("_seq_mid").alias("_seq_m0")))
    before = Window.partitionBy(*[f"_seq_k{i}" for i in range(len(keys))]) \
        .orderBy("_seq_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_seq_off", F.coalesce(F.sum("_seq_n").over(before), F.lit(0)))
    offsets = offsets.drop("_seq_n").withColumnRenamed("_seq_part", "_seq_p2")
    if not keys:
        # at most one row per partition: the size is bounded by n
        offsets = F.broadcast(offsets)

    cond = ranged["_seq_part"] == offsets["_seq_p2"]
    for i, k in enumerate(keys):
        cond = cond & ranged[k].eqNullSafe(offsets[f"_seq_k{i}"])
    joined = ranged.join(offsets, cond, "inner")
    out = joined.withColumn(
        name, (F.col("_seq_off") + F.col("_seq_mid") - F.col("_seq_m0") + 1).cast("long"))
    drop = ["_seq_mid", "_seq_m0", "_seq_off", "_seq_part", "_seq_p2"]
    return out.drop(*drop, *[f"_seq_k{i}" for i in range(len(keys))])


def running_total(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (),
                  name: str = "before", partitions: int | None = None) -> DataFrame:
    """Add ``name``: the sum of the long column ``value`` over the rows of
    the same ``keys`` that come before by ``order`` (total inside a group;
    null keys form one group). As in :func:`sequence` a group is spread over
    many tasks: sums inside each range partition, plus what earlier
    partitions hold of the group. ``df`` should be narrow."""
    n = partitions or target_partitions(df)
    keys = list(keys)
    ranged = stable(df.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], *order)
                      .withColumn("_sum_part", F.spark_partition_id()))
    inside = Window.partitionBy("_sum_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_sum_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    names = [f"_sum_k{i}" for i in range(len(keys))]
    runs = ranged.groupBy(F.col("_sum_part").alias("_sum_p2"), *[F.col(k).alias(m) for k, m in zip(keys, names)]) \
                 .agg(F.sum(value).alias("_sum_n"))
    before = Window.partitionBy(*names).orderBy("_sum_p2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_sum_off", F.coalesce(F.sum("_sum_n").over(before), F.lit(0))).drop("_sum_n")
    same = F.col("_sum_part") == F.col("_sum_p2")
    for k, m in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(m))
    return ranged.join(offsets, same).withColumn(name, (F.col("_sum_in") + F.col("_sum_off")).cast("long")) \
                 .drop("_sum_part", "_sum_in", "_sum_p2", "_sum_off", *names)
