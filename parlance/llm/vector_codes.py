"""Operator 13, product codes of vectors by Orchard search.

Every vector becomes whole numbers and is cut into equal parts; each part
position has a codebook of a few entries, refined over a fixed number of
rounds. A part's nearest entry is found by Orchard's search: every entry
keeps the others in order of their distance from it; starting from a likely
entry, its list is walked, an entry that is nearer takes over with its own
list, entries seen before are skipped, and a walk ends where the list goes
beyond twice the distance in hand, since nothing further on can be nearer.
Distances are whole numbers, so results do not depend on partitioning.

The codebooks (parts x entries, whatever the input) travel with the tasks;
what comes back from a round is one sum per entry and component.

Defined results: null vectors and those with a null or non-finite component
are dropped. ``width`` is the length of the vector of the smallest id whose
length is a positive multiple of the number of parts; vectors of another
length, and those with a component so large that the error might leave a
long (beyond 2**27 for 64 components, |x| of 32,768), stay with null code
and error and shape no codebook. Null ids count as the largest; rows that
repeat an id are rows of their own (equal ids are ordered by the vector).
An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, with_lookup

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
# Rows handled at a time; it bounds memory and keeps float sums exact.
BLOCK_ROWS = 1 << 16

Lists = tuple[np.ndarray, np.ndarray]


def largest_component(width: int) -> int:
    """Components up to this size, either sign, keep the squared distance of
    ``width`` of them below 2**62."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def neighbour_lists(book: np.ndarray) -> Lists:
    """For every entry, all entries by squared distance from it (then by
    index), and those distances."""
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    order = np.argsort(gaps, axis=1, kind="stable")
    return order, np.take_along_axis(gaps, order, 1)


def orchard_search(points: np.ndarray, book: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, the lowest
    index among equals. All points walk at once, each on its own list."""
    order, gaps = lists
    n, k = len(points), len(book)
    # The first entry to look at: the nearest by the sum of components.
    along = book.sum(1)
    ranked = np.argsort(along, kind="stable")
    right = np.clip(np.searchsorted(along[ranked], points.sum(1)), 0, k - 1)
    current = ranked[right]
    best = ((points - book[current]) ** 2).sum(1)
    at = np.zeros(n, np.int64)
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), current] = True
    walking = np.arange(n)
    while len(walking):
        walking = walking[at[walking] < k]
        # Entries beyond twice the distance are further from the point than
        # the entry in hand; at exactly twice they may be as near.
        here, place = current[walking], at[walking]
        on = gaps[here, place] <= 4 * best[walking]
        walking, here, place = walking[on], here[on], place[on]
        at[walking] = place + 1
        entry = order[here, place]
        fresh = ~seen[walking, entry]
        point, entry = walking[fresh], entry[fresh]
        seen[point, entry] = True
        found = ((points[point] - book[entry]) ** 2).sum(1)
        better = (found < best[point]) | ((found == best[point]) & (entry < current[point]))
        point = point[better]
        best[point], current[point], at[point] = found[better], entry[better], 0
    return current, best


def _blocks(column: pa.Array, width: int, parts: int) -> Iterator[np.ndarray]:
    """The rows of a list column without nulls as (rows, parts, length)."""
    for at in range(0, len(column), BLOCK_ROWS):
        part = column.slice(at, BLOCK_ROWS)
        yield part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), parts, width // parts)


def _sums_of(books: np.ndarray):
    """A task's (part, entry, place, total): per entry the sum of each
    component of its parts, and at place -1 how many there are."""
    parts, entries, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [neighbour_lists(b) for b in books]
        total = np.zeros((parts, entries, length + 1), np.int64)
        for batch in batches:
            for block in _blocks(batch.column(0), parts * length, parts):
                for p in range(parts):
                    code, _ = orchard_search(block[:, p], books[p], lists[p])
                    total[p, :, 0] += np.bincount(code, minlength=entries)
                    for j in range(length):
                        total[p, :, j + 1] += np.bincount(code, block[:, p, j], entries).astype(np.int64)
        part, entry, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.ravel(), pa.int32()), pa.array(entry.ravel(), pa.int32()),
             pa.array(place.ravel() - 1, pa.int32()), pa.array(total.ravel(), pa.int64())],
            ["part", "entry", "place", "total"])
    return run


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over ``vectors`` (ints, no nulls)."""
    totals = vectors.select("ints").mapInArrow(_sums_of(books), "part int, entry int, place int, total long") \
        .groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for row in totals:  # parts x entries x (length + 1) rows
        sums[row["part"], row["entry"], row["place"] + 1] = row["total"]
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


def coded(books: np.ndarray):
    parts, _, length = books.shape

    @F.arrow_udf("struct<code: string, error: bigint>")
    def code_and_error(ints: pa.Array) -> pa.Array:
        lists = [neighbour_lists(b) for b in books]
        present = ints.drop_null()
        codes, errors = [], []
        for block in _blocks(present, parts * length, parts):
            found = [orchard_search(block[:, p], books[p], lists[p]) for p in range(parts)]
            codes += [row.tobytes().hex() for row in np.stack([c for c, _ in found], 1).astype(np.uint8)]
            errors.append(sum(e for _, e in found))
        rows = np.full(len(ints), -1)
        rows[ints.is_valid().to_numpy(zero_copy_only=False)] = np.arange(len(present))
        take = pa.array(rows, mask=rows < 0)
        return pa.StructArray.from_arrays(
            [pa.array(codes, pa.string()).take(take),
             pa.array(np.concatenate([*errors, np.zeros(0, np.int64)]), pa.int64()).take(take)], ["code", "error"])
    return code_and_error


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scratch: Scratch | None = None) -> tuple[DataFrame, np.ndarray]:
    """(one row (``id_col``, ``label_col``, code, error) per kept vector,
    the codebooks as an array (part, entry, place)); at most 256 entries,
    fewer when there are fewer vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    scratch = scratch or Scratch(vectors.sparkSession, "vector-codes")
    v = F.col(vector_col)
    kept = vectors.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))) \
        .select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), v.alias("_vector"))
    sized = kept.where((F.size("_vector") > 0) & (F.size("_vector") % parts == 0))
    first = sized.select(F.col("_id"), F.size("_vector").alias("n")).orderBy(F.asc_nulls_last("_id"), "n").first()
    width = first["n"] if first else parts
    largest = largest_component(width)
    whole = F.transform("_vector", lambda x: F.floor(x.cast("double") * SCALE))
    fits = (F.size("_vector") == width) & F.forall("_vector", lambda x: F.abs(x.cast("double") * SCALE) < largest)
    ints = scratch.write(kept.select("_id", "_label", F.when(fits, whole.cast("array<int>")).alias("ints")), "ints")
    usable = ints.where(F.col("ints").isNotNull())
    start = [row["ints"] for row in usable.orderBy(F.asc_nulls_last("_id"), "ints").limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    if len(start):
        for _ in range(rounds):
            books = refined(usable, books)
        found = ints.withColumn("_found", coded(books)("ints"))
        found = found.select("_id", "_label", "_found.code", "_found.error")
    else:  # nothing that can be coded
        found = ints.select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return found.withColumnsRenamed({"_id": id_col, "_label": label_col}), books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "vector-codes")
    found, books = compress(table(spark, sf_dir, "embeddings"), scratch=scratch)
    found = scratch.write(found, "codes")
    scratch.drop("ints")
    totals = scratch.write(found.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    return with_lookup(found, totals, ["label"], F.col("vec_id")).select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
