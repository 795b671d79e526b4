"""Padded training batches (K1, K2).

Re-aimed from a training-time collate callback to a job that writes
batches. Rows are numbered in a global order (``ordinal.sequence``, range
partitioned, no single-partition window); batch ``b`` holds rows
``b*size+1 .. (b+1)*size``. Per-batch maxima are a window over the batch,
which is bounded by its size. All of that is done on keys and lengths; the
arrays are joined to it once.

* token ids are right-padded with ``pad_id`` to the batch's longest;
* label frames are padded to the batch's most frames with frames of
  ``label_pad`` (-100, ignored by the loss);
* with ``reduction > 1`` labels are then cut to the batch maximum of
  ``n - n % reduction`` (base pipeline only);
* other columns (a speaker vector, say) ride along, one per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable
from .ordinal import sequence
from .speakers import fetch

LABEL_PAD = -100.0


def pad_batches(df: DataFrame, size: int, order: Sequence[Column | str], ids_col: str = "input_ids",
                labels_col: str | None = "labels", pad_id: int = 0, label_pad: float = LABEL_PAD,
                reduction: int = 1, groups: Sequence[str] = ()) -> DataFrame:
    """Batches are numbered inside each ``groups`` value (e.g. the split
    side), so all sides are batched in one pass. ``order`` tells the rows of
    a group apart. Only it and the lengths are sorted and numbered; the
    arrays meet their batch once, by ``order``."""
    groups = list(groups)
    keyed, keys = df, list(groups)
    for i, o in enumerate(order):
        keyed = keyed.withColumn(f"_order_{i}", F.col(o) if isinstance(o, str) else o)
        keys.append(f"_order_{i}")
    lengths = {"_n_ids": F.size(ids_col)}
    if labels_col:
        lengths |= {"_n_lab": F.size(labels_col), "_frame": F.size(F.get(F.col(labels_col), 0))}
    numbered = sequence(keyed.select(*keys, *[c.alias(n) for n, c in lengths.items()]), keys[len(groups):],
                        keys=groups, name="_row_no")
    numbered = numbered.withColumn("batch_no", F.floor((F.col("_row_no") - 1) / F.lit(size)).cast("long")) \
                       .withColumn("batch_pos", ((F.col("_row_no") - 1) % F.lit(size)).cast("int"))
    batch = Window.partitionBy(*groups, "batch_no")
    numbered = numbered.withColumn("_max_ids", F.max("_n_ids").over(batch))
    if labels_col:
        n_lab = F.col("_n_lab")
        numbered = numbered.withColumn("_max_lab", F.max(n_lab).over(batch)) \
                           .withColumn("_max_lab_r", F.max(n_lab - n_lab % F.lit(reduction)).over(batch)) \
                           .withColumn("_width", F.max("_frame").over(batch))
    out = fetch(stable(numbered), keyed, keys, [c for c in df.columns if c not in groups])
    out = out.withColumn(ids_col, F.concat(
        F.col(ids_col), F.array_repeat(F.lit(pad_id), F.col("_max_ids") - F.size(ids_col))))
    added = ["batch_no", "batch_pos"]
    if labels_col:
        width = F.coalesce(F.col("_width"), F.lit(0))
        pad_frame = F.array_repeat(F.lit(label_pad).cast("float"), width)
        padded = F.concat(F.col(labels_col),
                          F.array_repeat(pad_frame, F.col("_max_lab") - F.size(labels_col)))
        if reduction > 1:
            padded = F.slice(padded, 1, F.col("_max_lab_r"))
        out = out.withColumn(labels_col, padded)
    return out.select(*df.columns, *added)
