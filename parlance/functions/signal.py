"""Fixed-rate signal cleaning on ``array<double>`` columns.

All but the high-pass filter are SQL higher-order functions (``transform``,
``aggregate``, ``slice``), evaluated row-locally inside the JVM. The
high-pass filter is a scalar ``pandas_udf`` (Arrow batches, numpy only);
column pruning and filter pushdown still work around it, unlike with
``mapInPandas``. Keep ``spark.sql.execution.arrow.maxRecordsPerBatch``
small for long signals: 10 s at 16 kHz is 1.28 MB per row.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Fixed values of the two cleaning chains (enhanced "B", voices "C").
RATE_B, HIGHPASS_B, SILENCE_B, MAX_SECONDS_B = 16000, 80.0, 0.01, 10
RATE_C, HIGHPASS_C, SILENCE_C, PAD_C, MIN_SECONDS_C, MAX_SECONDS_C, GAIN_C = 22050, 100.0, 0.02, 1000, 2, 15, 0.9
FILTER_ORDER = 4
MIN_SAMPLES_B = 8000


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(x: Column | str, fn) -> Column:
    """``fn`` of ``x`` with ``x`` evaluated once. A lambda body runs for each
    element, so whatever a lambda reads must come in as a variable: an
    expression written inside it would be evaluated again every time, which
    makes a pass over a signal quadratic."""
    return F.get(F.transform(F.array(_c(x)), fn), 0)


def duration(x: Column | str, rate: Column | str | int) -> Column:
    """P5: samples / rate, in seconds."""
    r = F.lit(rate) if isinstance(rate, int) else _c(rate)
    return F.size(_c(x)) / r.cast("double")


def downmix(xs: Column | str) -> Column:
    """Mean over channels of ``array<array<double>>`` (channels of equal
    length; the first channel's length is used)."""
    def mean(xs: Column) -> Column:
        n = F.coalesce(F.size(F.get(xs, 0)), F.lit(0))
        mixed = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.aggregate(xs, F.lit(0.0).cast("double"), lambda acc, ch: acc + F.element_at(ch, i))
            / F.size(xs))
        return F.when((F.size(xs) == 0) | (n == 0), F.array().cast("array<double>")).when(n > 0, mixed)

    return bound(xs, mean)


def peak(x: Column | str) -> Column:
    """Largest absolute sample (null for an empty signal)."""
    return F.array_max(F.transform(_c(x), lambda v: F.abs(v)))


def peak_normalize(x: Column | str, gain: float | None = None) -> Column:
    """Divide by the peak, then multiply by ``gain`` if given; an
    all-zero or empty signal is left as is."""
    def scaled(x: Column) -> Column:
        def by(m: Column) -> Column:
            return F.transform(x, lambda v: v / m if gain is None else v / m * F.lit(gain))
        m = peak(x)
        return F.when(m > 0, bound(m, by)).otherwise(x)

    return bound(x, scaled)


def _loud_bounds(x: Column, th: float):
    mask = F.transform(x, lambda v: F.abs(v) > F.lit(th))
    first = F.array_position(mask, True)  # 1-based, 0 when none
    last = F.size(x) - F.array_position(F.reverse(mask), True) + 1
    return first, last


def trim_silence_b(x: Column | str, th: float = SILENCE_B) -> Column:
    """Keep the first through the last sample with ``|v| > th``
    (inclusive); no such sample -> unchanged."""
    def cut(x: Column) -> Column:
        first, last = _loud_bounds(x, th)
        return F.when(first > 0, F.slice(x, first, last - first + 1)).otherwise(x)

    return bound(x, cut)


def trim_silence_c(x: Column | str, th: float = SILENCE_C, pad: int = PAD_C) -> Column:
    """With s/e the 0-based first/last loud sample and
    ``p = min(pad, s, n - e - 1)``, keep ``[s - p, e + p)`` -- the end is
    exclusive, so with p = 0 the last loud sample is dropped (and a single
    loud sample gives an empty signal). No loud sample -> unchanged."""
    def cut(x: Column) -> Column:
        first, last = _loud_bounds(x, th)
        s, e, n = first - 1, last - 1, F.size(x)
        p = F.least(F.lit(pad), s, n - e - 1)
        start, end = s - p, F.least(n, e + p)
        return F.when(first > 0, F.slice(x, start + 1, end - start)).otherwise(x)

    return bound(x, cut)


def clamp_len(x: Column | str, n: int) -> Column:
    """Cut to the first ``n`` samples."""
    return F.slice(_c(x), 1, n)


def min_len_or_null(x: Column | str, n: int) -> Column:
    """Null when shorter than ``n`` samples."""
    x = _c(x)
    return F.when(F.size(x) >= n, x)


def resample(x: Column | str, r_in: int | Column | str, r_out: int | Column | str) -> Column:
    """Linear-interpolation resampling to ``r_out``; length
    ``floor(n * r_out / r_in)``, the last sample held at the end. Not
    band-limited (no anti-alias filter). The rates are whole numbers, given
    or from columns, so that rows of different rates become one; a null or
    not positive rate gives null."""
    if isinstance(r_in, int) and isinstance(r_out, int) and r_in == r_out:
        return _c(x)
    r_in, r_out = ((F.lit(r) if isinstance(r, int) else _c(r)).cast("long") for r in (r_in, r_out))

    def interpolated(given: Column) -> Column:
        x, r_in, r_out = (given[k] for k in ("x", "r_in", "r_out"))
        n = F.size(x)
        m = F.floor(n.cast("long") * r_out / F.nullif(r_in, F.lit(0)))

        def at(i: Column) -> Column:
            # Whole numbers up to the last division: no drift along the signal.
            t = i * r_in
            left = t % r_out
            k = ((t - left) / r_out).cast("int")
            a = F.element_at(x, F.least(k + 1, n))
            b = F.element_at(x, F.least(k + 2, n))
            return a + left / r_out.cast("double") * (b - a)

        return F.when(r_in == r_out, x) \
                .when((r_in > 0) & (r_out > 0) & (m > 0), F.transform(F.sequence(F.lit(0).cast("long"), m - 1), at)) \
                .when((r_in > 0) & (r_out > 0) & (m == 0), F.array().cast("array<double>"))

    return bound(F.struct(_c(x).alias("x"), r_in.alias("r_in"), r_out.alias("r_out")), interpolated)


def l2_normalize(v: Column | str) -> Column:
    """Divide a vector by its Euclidean norm (in double); a zero
    vector stays zero."""
    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, y: acc + y * y))
        return F.when(norm > 0, bound(norm, lambda m: F.transform(v, lambda y: y / m))).otherwise(v)

    return bound(_c(v).cast("array<double>"), unit)


# --- N5: Butterworth high-pass --------------------------------------------

@functools.lru_cache(maxsize=16)
def _highpass_poles(order: int, fc: float, fs: float):
    """Digital zeros/poles/gain of an ``order``-th order Butterworth
    high-pass (bilinear transform with pre-warping). All zeros sit at z=1."""
    k = np.arange(1, order + 1)
    analog = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))  # unit-circle LP prototype
    warped = 2.0 * fs * np.tan(np.pi * fc / fs)
    hp = warped / analog                      # LP -> HP: s -> wc / s
    gain_a = 1.0 / np.real(np.prod(-analog))  # keeps unit gain at high frequency... (1 for Butterworth)
    fs2 = 2.0 * fs
    poles = (fs2 + hp) / (fs2 - hp)
    gain = gain_a * np.real(fs2 ** order / np.prod(fs2 - hp))
    return poles, gain


@functools.lru_cache(maxsize=16)
def highpass_modes(order: int, fc: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(poles, residues) of the filter's partial fractions: beside the
    sample itself times the gain, a past sample counts for the sum of
    residue * pole ** (how long ago it was)."""
    poles, gain = _highpass_poles(order, fc, fs)
    return poles, np.array([gain * (1 - 1 / p) ** order / np.prod(1 - np.delete(poles, i) / p)
                            for i, p in enumerate(poles)])


@functools.lru_cache(maxsize=16)
def _impulse_response(order: int, fc: float, fs: float, n: int) -> np.ndarray:
    """First ``n`` samples of the filter's impulse response, by partial
    fractions over its distinct poles."""
    poles, residues = highpass_modes(order, fc, fs)
    gain = _highpass_poles(order, fc, fs)[1]
    h = np.zeros(n)
    if n == 0:
        return h
    t = np.arange(n)
    acc = np.zeros(n, dtype=complex)
    for r, p in zip(residues, poles):
        acc += r * np.exp(t * np.log(p))
    h = np.real(acc)
    h[0] = gain
    return h


def highpass_numpy(x: np.ndarray, fc: float, fs: float, order: int = FILTER_ORDER) -> np.ndarray:
    """Causal filtering with zero initial state (``y = h * x`` cut to the
    signal's length), rounded to float32 like the reference's tensors."""
    return highpass_exact(x, fc, fs, order).astype(np.float32).astype(np.float64)


def highpass_exact(x: np.ndarray, fc: float, fs: float, order: int = FILTER_ORDER) -> np.ndarray:
    """:func:`highpass_numpy` before rounding."""
    n = len(x)
    if n == 0:
        return np.asarray(x, dtype=np.float64)
    size = 1 << int(np.ceil(np.log2(2 * n)))
    cached = 1 << int(np.ceil(np.log2(max(n, 1024))))
    h = _impulse_response(order, float(fc), float(fs), cached)[:n]
    return np.fft.irfft(np.fft.rfft(np.asarray(x, dtype=np.float64), size) * np.fft.rfft(h, size), size)[:n]


def filtered_or_none(x, fc: float, fs: float, order: int) -> np.ndarray | None:
    """The filtered signal, or None for a null signal and for one with a
    null or non-finite sample, which the callers turn into a reject."""
    if x is None:
        return None
    x = np.asarray(x, dtype=np.float64)
    return highpass_numpy(x, fc, fs, order) if np.isfinite(x).all() else None


def highpass(x: Column | str, fc: float, fs: float, order: int = FILTER_ORDER) -> Column:
    """Butterworth high-pass at ``fc`` Hz for rate ``fs``. Empty and null
    signals pass through; one with a null or non-finite sample gives null."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def _hp(s: pd.Series) -> pd.Series:
        return s.map(lambda a: filtered_or_none(a, fc, fs, order))
    return _hp(_c(x))


def highpass_step(x: str, fc: float, fs: float) -> Column:
    """:func:`highpass` of a column that was just computed. Naming the column
    twice keeps Catalyst from merging its higher-order functions into the
    function's argument, from where it does not extract Python functions."""
    return F.when(F.col(x).isNotNull(), highpass(x, fc, fs))


def with_clean_signal_b(df, x: str, out: str, rate: int = RATE_B, filtered: bool = True, fc: float = HIGHPASS_B):
    """N8 (enhanced): peak-normalise -> trim silence (inclusive) ->
    high-pass 80 Hz -> cut to 10 s. One column step at a time, so no step
    re-evaluates the ones before it."""
    df = df.withColumn(out, peak_normalize(x))
    df = df.withColumn(out, trim_silence_b(out, SILENCE_B))
    if filtered:
        df = df.withColumn(out, highpass_step(out, fc, rate))
    return df.withColumn(out, clamp_len(out, MAX_SECONDS_B * rate))


def with_clean_signal_c(df, x: str, out: str, rate: int = RATE_C, filtered: bool = True,
                        channels: bool = False, fc: float = HIGHPASS_C):
    """N8 (voices): [downmix] -> peak-normalise x 0.9 -> trim silence with
    padding -> high-pass 100 Hz -> null if under 2 s -> cut to 15 s."""
    df = df.withColumn(out, downmix(x) if channels else F.col(x))
    df = df.withColumn(out, peak_normalize(out, GAIN_C))
    df = df.withColumn(out, trim_silence_c(out, SILENCE_C, PAD_C))
    if filtered:
        df = df.withColumn(out, highpass_step(out, fc, rate))
    df = df.withColumn(out, min_len_or_null(out, MIN_SECONDS_C * rate))
    return df.withColumn(out, clamp_len(out, MAX_SECONDS_C * rate))
