"""Signals longer than a row: cleaning, resampling and filtering over
segments (N2-N9 for a signal cut into rows).

A long signal is held as rows (``keys``, ``order``, samples) of bounded
length, in any partitioning. The functions here give what the column
functions of ``functions.signal`` give for the whole signal, without ever
holding it: what a step needs to know about the whole (peak, length, first
and last loud sample, filter state) is found from one narrow row per segment,
and the samples meet it in one join by segment. A signal that holds a third
of all samples is many segments, and no step gathers them: totals are
combined before a shuffle, offsets and filter states come from range
partitions (``ordinal``), and per-signal values meet their segments through
``lookup``.

``keys`` and ``order`` tell the segments apart. Empty segments are allowed; a
null key is a signal of its own. A signal with a null segment has no result
(null), and so has one with a null or non-finite sample where a whole one
would have none.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import signal as N
from ..session import stable
from .lookup import lookup
from .ordinal import running_total, sequence, target_partitions
from .speakers import fetch

SAMPLES = "array<double>"


@dataclass(frozen=True)
class Chain:
    """The steps of a cleaning chain (N8): peak normalisation with a gain,
    silence trimming (``pad`` None: through the last loud sample; else with
    padding, its end left out), high-pass filter, shortest and longest
    result in samples."""
    rate: int
    silence: float
    fc: float
    max_samples: int
    gain: float | None = None
    pad: int | None = None
    min_samples: int = 0


def chain_b(rate: int = N.RATE_B, fc: float = N.HIGHPASS_B) -> Chain:
    return Chain(rate, N.SILENCE_B, fc, N.MAX_SECONDS_B * rate)


def chain_c(rate: int = N.RATE_C, fc: float = N.HIGHPASS_C) -> Chain:
    return Chain(rate, N.SILENCE_C, fc, N.MAX_SECONDS_C * rate, N.GAIN_C, N.PAD_C, N.MIN_SECONDS_C * rate)


@dataclass(frozen=True)
class Segments:
    """A corpus's signals as a table of segments: ``read`` gives it, ``key``
    names the column in which a signal and the rows of the corpus that have
    it agree. ``reads`` are the paths of the files behind it (for stages)."""
    read: Callable[[], DataFrame]
    key: str
    order: str = "clip_no"
    x: str = "x"
    reads: tuple[str, ...] = ()


def with_lengths(rows: DataFrame, segments: Segments) -> DataFrame:
    """``rows`` with ``n_samples`` of the signal that each has; null for a
    row without one."""
    lengths = stable(signal_lengths(segments.read(), [segments.key], segments.x))
    return lookup(rows, lengths.where(F.col(segments.key).isNotNull()), [segments.key], F.monotonically_increasing_id())


def with_clean_segments(rows: DataFrame, segments: Segments, chain: Chain, out: str,
                        rate_in: int | None = None) -> DataFrame:
    """``rows`` with ``out``, the signal of each, resampled from ``rate_in``
    to the chain's rate (if given) and cleaned; null for a row without one.
    Only signals that ``rows`` (checkpointed or written) have are cleaned,
    each once, however many rows share it."""
    key = segments.key
    used = stable(rows.select(key).where(F.col(key).isNotNull()).distinct())
    seg = segments.read().select(key, F.col(segments.order).alias("clip_no"), F.col(segments.x).alias("x"))
    seg = lookup(seg, used, [key], F.col("clip_no"), "inner")
    if rate_in is not None and rate_in != chain.rate:
        seg = stable(resample_segments(seg, [key], rate_in, chain.rate))  # read three times
    clean = clean_segments(seg, [key], chain).select(F.col(key).alias("_signal_of"), F.col("signal").alias(out))
    return rows.join(clean, F.col(key) == F.col("_signal_of"), "left").drop("_signal_of")


def signal_lengths(segments: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """(keys, n_samples) of every signal; null for one with a null segment."""
    return segments.groupBy(*keys).agg(
        F.when(F.max(F.col(x).isNull()), None).otherwise(F.sum(F.size(x))).cast("long").alias("n_samples"))


def _is_bad(v: Column) -> Column:
    return v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))


def _scaled(x: Column, m: Column, gain: float | None) -> Column:
    """As ``peak_normalize`` with the whole signal's peak."""
    both = F.struct(x.alias("x"), m.alias("m"))
    return N.bound(both, lambda b: F.when(b["m"] > 0, F.transform(
        b["x"], lambda v: v / b["m"] if gain is None else v / b["m"] * F.lit(gain))).otherwise(b["x"]))


def clean_segments(segments: DataFrame, keys: Sequence[str], chain: Chain, order: str = "clip_no",
                   x: str = "x") -> DataFrame:
    """(keys, signal): every signal cleaned as one (N8). The result is at
    most ``chain.max_samples`` long, whatever the signal's length; only the
    segments that reach into it are gathered, a signal at a time."""
    keys = list(keys)
    each = [*keys, "_no"]
    seg = segments.select(*keys, F.col(order).alias("_no"), F.col(x).cast(SAMPLES).alias("_x"))
    measured = stable(seg.select(*each, F.coalesce(F.size("_x"), F.lit(0)).cast("long").alias("_n"),
                                 F.col("_x").isNull().alias("_missing"), N.peak("_x").alias("_peak")))
    whole = stable(measured.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.max("_peak").alias("_m"),
                                               F.max("_missing").alias("_missing")))
    placed = running_total(measured.select(*each, "_n"), "_n", ["_no"], keys, "_before")
    # One row per segment: where it lies, and what its signal is scaled by.
    placed = lookup(placed, whole.select(*keys, "_m"), keys, F.col("_no"))

    scaled = fetch(placed, seg, each, ["_x"]).withColumn("_y", _scaled(F.col("_x"), F.col("_m"), chain.gain))
    mask = F.transform("_y", lambda v: F.abs(v) > F.lit(chain.silence))
    loud = scaled.withColumn("_mask", mask).select(
        *each, "_n", "_before", "_m", F.exists("_y", _is_bad).alias("_bad"),
        (F.nullif(F.array_position("_mask", True), F.lit(0).cast("long")) - 1).alias("_first"),
        (F.size("_mask") - F.nullif(F.array_position(F.reverse("_mask"), True), F.lit(0).cast("long"))).alias("_last"))
    loud = stable(loud)

    bounds = loud.groupBy(*keys).agg(F.min(F.col("_before") + F.col("_first")).alias("_s"),
                                     F.max(F.col("_before") + F.col("_last")).alias("_e"))
    bounds = fetch_left(whole.drop("_m"), bounds, keys)
    s, e, n = F.col("_s"), F.col("_e"), F.col("_total")
    if chain.pad is None:
        start, end = s, e + 1
    else:
        p = F.least(F.lit(chain.pad).cast("long"), s, n - e - 1)
        start, end = s - p, F.least(n, e + p)
    bounds = bounds.withColumn("_start", F.coalesce(start, F.lit(0).cast("long"))) \
                   .withColumn("_end", F.coalesce(end, n))
    bounds = stable(bounds.select(*keys, "_missing", "_start", "_end",
                                  F.least(F.col("_end"), F.col("_start") + chain.max_samples).alias("_cut")))

    # What lies between start and end: the part before the cut is the result;
    # a bad sample anywhere in it leaves none.
    low, high = F.col("_before"), F.col("_before") + F.col("_n")
    inside = lookup(loud, bounds.drop("_missing"), keys, F.col("_no"), "inner") \
        .where((high > F.col("_start")) & (low < F.col("_end")))
    full = (low >= F.col("_start")) & (high <= F.col("_end"))
    wanted = (low < F.col("_cut")) | (F.col("_bad") & ~full)
    known = inside.where(~wanted & F.col("_bad")).select(*keys, F.lit(True).alias("_spoilt"), F.lit(None).cast("int").alias("_no"),
                                                         F.lit(None).cast(SAMPLES).alias("_piece"))
    read = fetch(inside.where(wanted), seg, each, ["_x"]).withColumn("_y", _scaled(F.col("_x"), F.col("_m"), chain.gain))

    def between(a: str, b: str) -> Column:
        begin = F.greatest(F.col(a) - F.col("_before"), F.lit(0).cast("long")).cast("int")
        stop = F.least(F.col(b) - F.col("_before"), F.col("_n")).cast("int")
        return F.slice("_y", begin + 1, F.greatest(stop - begin, F.lit(0)))

    read = read.select(*keys, F.exists(between("_start", "_end"), _is_bad).alias("_spoilt"), "_no",
                       F.when(low < F.col("_cut"), between("_start", "_cut")).alias("_piece"))
    joined = read.unionByName(known.withColumn("_no", F.col("_no").cast(read.schema["_no"].dataType))).groupBy(*keys).agg(
        F.max("_spoilt").alias("_spoilt"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct("_no", "_piece")))),
                              lambda p: p["_piece"])).alias("_signal"))
    out = fetch_left(bounds, joined, keys)
    none = F.col("_missing") | F.coalesce(F.col("_spoilt"), F.lit(False)) | (F.col("_end") - F.col("_start") < chain.min_samples)
    out = out.withColumn("signal", F.when(~none, F.coalesce("_signal", F.array().cast(SAMPLES)))).select(*keys, "signal")
    return out.withColumn("signal", N.highpass_step("signal", chain.fc, chain.rate))


def fetch_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of two tables with one row per ``keys`` (null equals null)."""
    own = {k: f"_left_{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    for k, name in own.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(own), same, "left").drop(*own.values())


def resample_segments(segments: DataFrame, keys: Sequence[str], r_in: int, r_out: int, order: str = "clip_no",
                      x: str = "x") -> DataFrame:
    """(keys, order, x): every signal resampled as one (N9). A segment gives
    the samples that lie on it; the step to the next segment reads that
    one's first sample."""
    if r_in == r_out:
        return segments.select(*keys, order, F.col(x).cast(SAMPLES).alias("x"))
    keys = list(keys)
    each = [*keys, "_no"]
    seg = segments.select(*keys, F.col(order).alias("_no"), F.col(x).cast(SAMPLES).alias("_x"))
    measured = stable(seg.select(*each, F.coalesce(F.size("_x"), F.lit(0)).cast("long").alias("_n"),
                                 F.get("_x", F.lit(0)).alias("_head")))
    whole = stable(measured.groupBy(*keys).agg(F.sum("_n").alias("_total")))
    placed = running_total(measured.select(*each, "_n"), "_n", ["_no"], keys, "_before")
    placed = lookup(placed, whole, keys, F.col("_no"))
    numbered = sequence(measured.where("_n > 0").select(*each, "_head"), ["_no"], keys, "_seq")
    after = numbered.select(*keys, (F.col("_seq") - 1).alias("_seq"), F.col("_head").alias("_next"), F.lit(True).alias("_more"))
    heads = fetch_left(numbered.drop("_head"), after, [*keys, "_seq"]).drop("_seq")
    placed = fetch_left(placed, heads, each)

    def up(of: Column) -> Column:  # the first output sample at or after an input sample
        return F.floor((of * r_out + (r_in - 1)) / F.lit(r_in)).cast("long")

    got = fetch(placed, seg, each, ["_x"])
    first = up(F.col("_before"))
    stop = F.least(up(F.col("_before") + F.col("_n")), F.floor(F.col("_total") * r_out / F.lit(r_in)).cast("long"))
    given = F.struct(F.col("_x").alias("x"), F.col("_before").alias("before"), F.col("_next").alias("next"),
                     F.col("_n").alias("n"), F.col("_more").alias("more"), first.alias("first"), stop.alias("stop"))

    def interpolated(g: Column) -> Column:
        def at(i: Column) -> Column:
            t = i * F.lit(r_in).cast("long")
            left = t % F.lit(r_out).cast("long")
            k = ((t - left) / F.lit(r_out) - g["before"]).cast("int")
            a = F.element_at(g["x"], k + 1)
            b = F.when(k + 1 < g["n"], F.get(g["x"], k + 1)).when(g["more"], g["next"]).otherwise(a)
            return a + left / F.lit(float(r_out)) * (b - a)
        return F.when(g["x"].isNotNull() & (g["stop"] > g["first"]), F.transform(F.sequence(g["first"], g["stop"] - 1), at)) \
                .when(g["x"].isNotNull(), F.array().cast(SAMPLES))

    return got.select(*keys, F.col("_no").alias(order), N.bound(given, interpolated).alias("x"))


# --- N5: the filter's state runs through the segments ------------------------------

@functools.lru_cache(maxsize=16)
def _upper_modes(order: int, fc: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of conjugate poles one, with twice its residue: their
    sum is twice the real part."""
    poles, residues = N.highpass_modes(order, fc, fs)
    upper = poles.imag > 0
    return poles[upper], 2 * residues[upper]


def _end_state(x: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """What a segment adds to the state by its end: per pole the sum of its
    samples, each times the pole to the power of its distance from the end.
    Beyond the distance at which that is nothing samples are left out."""
    reach = min(len(x), int(np.ceil(np.log(1e-20) / np.log(np.abs(poles).max()))) + 1)
    last = x[len(x) - reach:][::-1]
    return np.array([np.sum(last * np.exp(np.arange(reach) * np.log(p))) for p in poles])


def _carried(state: np.ndarray, n: int, poles: np.ndarray) -> np.ndarray:
    return state * np.exp(n * np.log(poles))


def highpass_segments(segments: DataFrame, keys: Sequence[str], fc: float, fs: float, order: str = "clip_no",
                      x: str = "x", poles_order: int = N.FILTER_ORDER) -> DataFrame:
    """(keys, order, y): every signal filtered as one (N5), segment by
    segment. The filter is a sum of modes, each with one number of state; a
    segment takes the state s at its start to ``pole ** n * s + own`` at its
    end, and such steps compose. Segments are composed in order inside range
    partitions, the partitions of a signal after that (one row each), and
    each segment is then filtered from the state that reaches it. A null
    segment, or one with a null or non-finite sample, gives null and so do
    all later ones of its signal, which its samples would reach."""
    keys = list(keys)
    each = [*keys, "_no"]
    seg = segments.select(*keys, F.col(order).alias("_no"), F.col(x).cast(SAMPLES).alias("_x"))
    poles, _ = _upper_modes(poles_order, float(fc), float(fs))
    width = 2 * len(poles)
    nothing = [0.0] * width

    @F.pandas_udf(ArrayType(DoubleType()))
    def own_state(column: pd.Series) -> pd.Series:
        def state(a):
            if a is None:
                return None
            a = np.asarray(a, dtype=np.float64)
            return _end_state(a, poles).view(np.float64) if np.isfinite(a).all() else None
        return column.map(state)

    ends = seg.select(*each, F.coalesce(F.size("_x"), F.lit(0)).cast("long").alias("_n"), own_state("_x").alias("_own"))
    sort = [*[F.col(k).asc_nulls_first() for k in keys], F.col("_no")]
    ranged = stable(ends.repartitionByRange(target_partitions(ends), *sort).sortWithinPartitions(*sort)
                        .withColumn("_part", F.spark_partition_id()))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order: the state and the samples before each, from
        the first of its signal in this partition on, and the state after."""
        signal, state, at = object(), np.zeros(len(poles), complex), 0
        for batch in batches:
            rows = batch.to_pylist()
            before, after, offset = [], [], []
            for row in rows:
                key = tuple(row[k] for k in keys)
                if key != signal:
                    signal, state, at = key, np.zeros(len(poles), complex), 0
                before.append(state.view(np.float64).tolist())
                offset.append(at)
                own = row["_own"]
                added = np.full(len(poles), np.nan, complex) if own is None else np.array(own).view(complex)
                state, at = _carried(state, row["_n"], poles) + added, at + row["_n"]
                after.append(state.view(np.float64).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before, pa.list_(pa.float64())), pa.array(after, pa.list_(pa.float64())),
                 pa.array(offset, pa.int64())], [*batch.schema.names, "_before", "_after", "_offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    local = stable(ranged.mapInArrow(composed, f"{fields}, _before {SAMPLES}, _after {SAMPLES}, _offset long"))
    totals = local.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n"), F.max_by("_after", "_no").alias("_after"))

    def chained(part: pd.DataFrame) -> pd.DataFrame:
        """A signal's partitions in order (one row each)."""
        part = part.sort_values("_part")
        state, carry = np.zeros(len(poles), complex), []
        for n, after in zip(part["_n"], part["_after"]):
            carry.append(state.view(np.float64).tolist())
            state = _carried(state, n, poles) + np.array(after, dtype=np.float64).view(complex)
        return part[[*keys, "_part"]].assign(_carry=carry)

    shape = ", ".join(f"`{k}` {totals.schema[k].dataType.simpleString()}" for k in keys)
    # Most signals lie in one partition and carry nothing in.
    spread = F.count(F.lit(1)).alias("_parts")
    many = totals.groupBy(*keys).agg(spread).where("_parts > 1").drop("_parts")
    carried = stable(fetch(many, totals, keys, ["_part", "_n", "_after"]).groupBy(*keys)
                     .applyInPandas(chained, f"{shape}, _part int, _carry {SAMPLES}"))
    states = lookup(local.drop("_own", "_after", "_n"), carried, [*keys, "_part"], F.col("_no"))
    zero = F.array(*[F.lit(v) for v in nothing])
    states = states.withColumn("_carry", F.coalesce("_carry", zero)).drop("_part")

    @F.pandas_udf(ArrayType(DoubleType()))
    def filtered(x: pd.Series, before: pd.Series, carry: pd.Series, offset: pd.Series) -> pd.Series:
        modes, weights = _upper_modes(poles_order, float(fc), float(fs))

        def one(a, b, c, n):
            if a is None:
                return None
            a = np.asarray(a, dtype=np.float64)
            state = np.array(b, dtype=np.float64).view(complex) + _carried(np.array(c, dtype=np.float64).view(complex), n, modes)
            if not (np.isfinite(a).all() and np.isfinite(state).all()):
                return None
            y = N.highpass_exact(a, fc, fs, poles_order)
            t = np.arange(1, len(a) + 1)
            for p, r, z in zip(modes, weights, state):
                y = y + np.real(r * z * np.exp(t * np.log(p)))
            return y.astype(np.float32).astype(np.float64)
        return pd.Series([one(*row) for row in zip(x, before, carry, offset)], dtype=object)

    got = fetch(states, seg, each, ["_x"])
    y = F.when(F.col("_x").isNotNull(), filtered("_x", "_before", "_carry", "_offset"))
    return got.withColumn("y", y).select(*keys, F.col("_no").alias(order), "y")
