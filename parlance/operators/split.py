"""Reproducible train/test splits.

A row's side depends only on ``md5("<seed>:<key>")``, never on partitioning
or row order (which ``randomSplit`` depends on).

* ``exact=False`` (default, for scale): test when the first 32 bits of the
  hash are below ``fraction * 2**32``. A per-row expression: no shuffle, no
  count; the test size is ``fraction * n`` in expectation.
* ``exact=True``: the ``ceil(n * fraction)`` rows with the smallest hashes.
  The largest hash among them is found by counting hashes by their first
  digits, then by the next digits within the group that it lies in, until
  few are left; the split is then the same per-row test, and neither the
  rows nor their keys are sorted or moved. Rows of one key stay together, so
  the test side is larger than that by at most the rows of its last key.

A null key is a key of its own.

The rows chosen can never equal the reference library's shuffle; the
properties kept are the fraction, the seed and disjoint, complete sides.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_32 = 4294967296  # 2**32


#: hex digits counted at a time (65,536 counts at most), and how many hashes
#: of one group are sorted
DIGITS, FEW = 4, 1 << 16


def split_hash(seed: int, key: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit(":"), k.cast("string")), F.lit(""))))


def smallest_share(df: DataFrame, h: Column, fraction: float) -> str | None:
    """The ``ceil(n * fraction)``-th smallest of the hashes ``h`` (hex, all
    of one length) of the n rows of ``df``; None when that is none of them.
    Only counts by digits, and at most ``FEW`` hashes, leave the executors."""
    hashes, prefix, want = df.select(h.alias("_h")), "", None
    while True:
        inside = hashes.where(F.col("_h").startswith(prefix)) if prefix else hashes
        digits = F.substring("_h", len(prefix) + 1, DIGITS)
        counts = inside.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
        if want is None:
            want = math.ceil(round(sum(r["n"] for r in counts) * fraction, 9))
            if want <= 0:
                return None
        for row in counts:
            if want <= row["n"]:
                break
            want -= row["n"]
        if row["d"] == "":  # all digits are used up: one hash
            return prefix
        prefix += row["d"]
        if row["n"] <= FEW:
            last = hashes.where(F.col("_h").startswith(prefix)).orderBy("_h").limit(want)
            return last.agg(F.max("_h")).first()[0]


def assign_split(df: DataFrame, fraction: float, key: str, seed: int | None = 42,
                 exact: bool = False, name: str = "is_test") -> tuple[DataFrame, int]:
    """Add boolean ``name`` (True = test side). Returns the frame and the
    seed used: with ``seed=None`` one is drawn and returned so the split
    can be repeated (R1)."""
    if seed is None:
        seed = random.SystemRandom().randrange(1 << 31)
    h = split_hash(seed, key)
    if not exact:
        first32 = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
        return df.withColumn(name, first32 < F.lit(fraction * TWO_32)), seed
    last = smallest_share(df, h, fraction)
    return df.withColumn(name, F.lit(False) if last is None else h <= F.lit(last)), seed


def train_test(df: DataFrame, fraction: float, key: str, seed: int | None = 42,
               exact: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(train, test, seed)."""
    marked, seed = assign_split(df, fraction, key, seed, exact)
    return (marked.where(~F.col("is_test")).drop("is_test"),
            marked.where(F.col("is_test")).drop("is_test"), seed)
