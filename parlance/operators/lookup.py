"""Joining rows to a table with one row per key, whatever its size and
however many rows share a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a table of up to this many rows of a few numbers or short strings may be
#: broadcast (some 20 MB at most)
BROADCAST_ROWS = 1 << 17
#: tasks that the rows of one key are dealt to when the table is longer
SALTS = 16


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread_by: Column, how: str = "left",
           salts: int = SALTS, narrow: bool = True) -> DataFrame:
    """``rows`` joined with ``table`` (checkpointed or written, one row per
    ``keys``, null equal to null, and no other column of ``rows``). A short
    table of ``narrow`` rows is broadcast, its rows counted first. Else both
    are shuffled, every key dealt to ``salts`` tasks by ``spread_by``, so
    that a key which a third of the rows share does not fill one task."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = table.withColumnsRenamed(names)
    same = F.lit(True)
    for k, name in names.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    if narrow and table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), same, how).drop(*names.values())
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    right = right.withColumn("_salt_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(right, same & (F.col("_salt") == F.col("_salt_of")), how) \
        .drop("_salt", "_salt_of", *names.values())
