"""Helpers shared by the operators: reading the tables, and writing
intermediate tables into the folder that every executor can reach."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# The words of every operator are runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be of any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release_memory() -> None:
    """Give back to the system what Arrow and the C library keep for later.
    Spark reuses its Python workers, so what one batch or stage once needed
    would otherwise stay theirs while the next one runs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Scratch:
    """Intermediate tables of one run of an operator, as Parquet under
    ``spark.checkpoint.dir`` (shared by driver and executors): a written
    table cuts the lineage and is there after an executor is lost.

    ``drop`` deletes one that no later step reads; the tables that the
    returned frame still reads stay until the caller drops the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def global_prefix(scratch: Scratch, df: DataFrame, order: list[Column], sums: dict[str, str],
                  name: str = "ranged") -> DataFrame:
    """Exclusive prefix sums over the whole of ``df`` by ``order``.

    ``sums`` maps an output column to the long column it adds up. The rows
    are range-partitioned by ``order`` (ties are split by a running row
    number, so one repeated key never fills a partition), written once with
    the partition they fell into, added up inside each partition, and
    shifted by the totals of the partitions before it (one row per
    partition)."""
    spark = df.sparkSession
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie")]
    ranged = scratch.write(
        tagged.repartitionByRange(shuffle_partitions(spark), *keys)
              .withColumn("_part", F.spark_partition_id()), name)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_total_{o}") for o, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[
        F.coalesce(F.sum(f"_total_{o}").over(before), F.lit(0)).alias(f"_before_{o}") for o in sums])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({f"_in_{o}": F.coalesce(F.sum(c).over(inside), F.lit(0))
                              for o, c in sums.items()})
    # At most one row per range partition, so the broadcast is bounded.
    out = out.join(F.broadcast(offsets), "_part")
    out = out.withColumns({o: F.col(f"_in_{o}") + F.col(f"_before_{o}") for o in sums})
    return out.drop("_part", "_tie", *[f"_in_{o}" for o in sums], *[f"_before_{o}" for o in sums])


# A table of up to this many rows of a few numbers or short strings may be
# broadcast (some 20 MB at most); a longer one is shuffled.
BROADCAST_ROWS = 1 << 17
SALTS = 16


def with_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread_by: Column,
                how: str = "left", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``lookup``, a written table with one row per
    ``keys`` (null equals null) and no other column of ``rows``. A short
    lookup is broadcast, its rows counted first. Else both are shuffled,
    every key dealt to ``salts`` tasks by ``spread_by``, so that a key
    which a third of the rows share does not fill one task."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = lookup.withColumnsRenamed(names)
    same = F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    if lookup.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), same, how).drop(*names.values())
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    right = right.withColumn("_salt_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(right, same & (F.col("_salt") == F.col("_salt_of")), how) \
        .drop("_salt", "_salt_of", *names.values())
