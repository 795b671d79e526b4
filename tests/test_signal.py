"""N1-N10 on hand-made signals, with results worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import signal as N


def biquad_loop(x, fc, fs):
    """The high-pass sample by sample: two second-order sections in the
    textbook form (bilinear transform, quality factors of order 4)."""
    y = np.asarray(x, dtype=float)
    k = np.tan(np.pi * fc / fs)
    for angle in (np.pi / 8, 3 * np.pi / 8):
        q = 2 * np.cos(angle)
        d = 1 + k * q + k * k
        b, a1, a2 = 1 / d, 2 * (k * k - 1) / d, (1 - k * q + k * k) / d
        out, u1, u2, v1, v2 = [], 0.0, 0.0, 0.0, 0.0
        for u in y:
            v = b * (u - 2 * u1 + u2) - a1 * v1 - a2 * v2
            u1, u2, v1, v2 = u, u1, v, v1
            out.append(v)
        y = np.array(out)
    return y


SIGNALS = [
    [], [0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, -1.0],
    [0.01, 0.5, 0.02, 0.5, 0.01], [0.02, 0.021, 0.5, 0.021, 0.02], [-3.0, 1.5, 0.0, 0.75],
    list(np.linspace(-1, 1, 57)), [0.0] * 5 + [0.3] * 3 + [0.0] * 2,
]


@pytest.fixture(scope="module")
def sig(spark):
    return spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(SIGNALS)], "id int, x array<double>")


def _collect(df, col):
    return {r["id"]: (None if r[col] is None else list(r[col])) for r in df.select("id", col).collect()}


def test_peak_normalize(sig):
    got = _collect(sig.withColumn("y", N.peak_normalize("x", 0.9)), "y")
    for i, s in enumerate(SIGNALS):
        x = np.asarray(s, dtype=float)
        m = np.max(np.abs(x)) if len(x) else 0.0
        want = x / m * 0.9 if m > 0 else x
        assert np.array_equal(np.asarray(got[i]), want)


#: signal, trimmed by B, by C with padding 1, by C with padding 1000; threshold 0.02
TRIMMED = [
    ([], [], [], []),
    ([0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]),
    ([0.0, 0.0, 1.0, 0.0, 0.0], [1.0], [0.0, 1.0], [0.0, 0.0, 1.0, 0.0]),
    ([1.0, 0.0, 0.0, 0.0], [1.0], [], []),
    ([0.0, 0.0, 0.0, -1.0], [-1.0], [], []),
    ([0.01, 0.5, 0.02, 0.5, 0.01], [0.5, 0.02, 0.5], [0.01, 0.5, 0.02, 0.5], [0.01, 0.5, 0.02, 0.5]),
    ([0.02, 0.021, 0.5, 0.021, 0.02], [0.021, 0.5, 0.021], [0.02, 0.021, 0.5, 0.021], [0.02, 0.021, 0.5, 0.021]),
    ([-3.0, 1.5, 0.0, 0.75], [-3.0, 1.5, 0.0, 0.75], [-3.0, 1.5, 0.0], [-3.0, 1.5, 0.0]),
    ([0.0, 0.0, 0.0, 2.0, 2.0, 0.0, 0.0], [2.0, 2.0], [0.0, 2.0, 2.0], [0.0, 0.0, 2.0, 2.0, 0.0]),
]


def test_trim_b_and_c(spark):
    df = spark.createDataFrame([(i, s[0]) for i, s in enumerate(TRIMMED)], "id int, x array<double>")
    got = df.select("id", N.trim_silence_b("x", 0.02).alias("b"), N.trim_silence_c("x", 0.02, 1).alias("c"),
                    N.trim_silence_c("x", 0.02, 1000).alias("d")).collect()
    for r in got:
        assert (r["b"], r["c"], r["d"]) == TRIMMED[r["id"]][1:], TRIMMED[r["id"]][0]


def test_trim_c_single_loud_sample_at_end_is_empty(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 1.0])], "id int, x array<double>")
    assert df.select(N.trim_silence_c("x", 0.02, 1000)).first()[0] == []


def test_clamp_min_len_duration(sig):
    out = sig.select("id", N.clamp_len("x", 3).alias("c"), N.min_len_or_null("x", 5).alias("m"),
                     N.duration("x", 2).alias("d")).collect()
    for r in out:
        s = SIGNALS[r["id"]]
        assert list(r["c"]) == s[:3]
        assert (r["m"] is None) == (len(s) < 5)
        assert r["d"] == len(s) / 2


def test_downmix(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0, 3.0]]), (1, [[1.0, 2.0], [3.0, 6.0]]), (2, [])],
                               "id int, xs array<array<double>>")
    got = _collect(df.withColumn("m", N.downmix("xs")), "m")
    assert got == {0: [1.0, 2.0, 3.0], 1: [2.0, 4.0], 2: []}


def test_resample(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0, 2.0, 3.0]), (1, [])], "id int, x array<double>")
    got = _collect(df.withColumn("y", N.resample("x", 2, 3)), "y")
    want = [0.0, 2 / 3, 4 / 3, 2.0, 8 / 3, 3.0]
    assert np.allclose(got[0], want) and got[1] == []


def test_l2_normalize(spark):
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "id int, v array<float>")
    got = _collect(df.withColumn("n", N.l2_normalize("v")), "n")
    assert got == {0: [0.6, 0.8], 1: [0.0, 0.0]}


def test_highpass_equals_sample_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    for fc, fs in ((80.0, 16000), (100.0, 22050)):
        want = biquad_loop(x, fc, fs).astype(np.float32).astype(np.float64)
        got = N.highpass_numpy(x, fc, fs)
        assert np.max(np.abs(got - want)) < 1e-6
    df = spark.createDataFrame([(0, [float(v) for v in x[:500]]), (1, [])], "id int, x array<double>")
    rows = _collect(df.withColumn("y", N.highpass("x", 80.0, 16000)), "y")
    assert rows[1] == [] and np.allclose(rows[0], N.highpass_numpy(x[:500], 80.0, 16000))


@pytest.mark.parametrize("fc,fs", [(80.0, 16000), (100.0, 22050)])
def test_highpass_gain_at_cutoff_and_decade_below(fc, fs):
    n = fs * 4
    t = np.arange(n) / fs

    def gain(f):
        y = N.highpass_numpy(np.sin(2 * np.pi * f * t), fc, fs)
        tail = slice(n // 2, n)
        return np.sqrt(np.mean(y[tail] ** 2)) / np.sqrt(0.5)

    assert abs(gain(fc) - 0.7071) < 0.01
    assert 20 * np.log10(gain(fc / 10)) < -40
    assert abs(gain(min(fc * 10, fs / 4)) - 1) < 0.01


def test_chain_c_too_short_is_null(spark):
    rate = 8
    df = spark.createDataFrame([(0, [0.0] + [1.0] * 10 + [0.0]), (1, [0.5] * 200)], "id int, x array<double>")
    got = _collect(N.with_clean_signal_c(df, "x", "y", rate, filtered=False), "y")
    assert got[0] is None                      # 10 samples < 2 s * 8
    assert len(got[1]) == 15 * rate            # cut to 15 s


def test_chains_with_the_filter_on(spark):
    """Normalise, trim, filter, cut: each step by hand but the filter, which
    the loop gives."""
    rng = np.random.default_rng(3)
    x = np.concatenate((np.zeros(5), rng.normal(size=60), np.zeros(7)))
    df = spark.createDataFrame([(0, x.tolist())], "id int, x array<double>")
    loud = x[5:65] / np.abs(x).max()
    b = _collect(N.with_clean_signal_b(df, "x", "y", 4, fc=0.5), "y")[0]
    assert np.allclose(b, biquad_loop(loud, 0.5, 4)[:40], atol=1e-6) and len(b) == 40
    stereo = spark.createDataFrame([(0, [x.tolist(), x.tolist()])], "id int, x array<array<double>>")
    c = _collect(N.with_clean_signal_c(stereo, "x", "y", 4, channels=True, fc=0.5), "y")[0]
    padded = x[:70] / np.abs(x).max() * 0.9  # five samples of padding on both sides, the last left out
    assert len(c) == 60 and np.allclose(c, biquad_loop(padded, 0.5, 4)[:60], atol=1e-6)


def test_bad_samples_become_rejects(spark):
    from parlance.operators.quality import prepare_or_reject

    rows = [(0, [1.0, None, 2.0]), (1, [1.0, float("nan")]), (2, None), (3, [0.5] * 40), (4, [])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    out = prepare_or_reject(df, N.highpass("x", 0.5, 4), [], "y").collect()
    assert {r["id"]: r["reject_reason"] for r in out} == {0: "no_result", 1: "no_result", 2: "no_result", 3: None, 4: None}


@pytest.mark.parametrize("name,fn", [
    ("peak", lambda: N.peak_normalize("x", 0.9)), ("l2", lambda: N.l2_normalize("x")),
    ("resample", lambda: N.resample("x", 8, 11)), ("trim", lambda: N.trim_silence_c("x")),
    ("downmix", lambda: N.downmix(F.array(F.col("x"), F.reverse("x"))))])
def test_long_signals_take_linear_time(spark, name, fn):
    import time

    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i.cast("double"))).alias("x"))
        df = df.select(F.size(fn()).alias("n"))
        best = 1e9
        for _ in range(3):
            t = time.perf_counter()
            df.collect()
            best = min(best, time.perf_counter() - t)
        return best

    seconds(1000)
    assert seconds(160_000) < 10 * seconds(16_000) + 2.0, name  # 100 times, if it were quadratic
