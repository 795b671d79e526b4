"""Signals cut into rows against the same signals held whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import signal as N
from parlance.operators import lookup as LK
from parlance.operators import segments as SEG
from parlance.operators.ordinal import running_total

from test_signal import biquad_loop

RATE = 8
SCHEMA = "speaker string, clip_no int, x array<double>"


def _signals(seed):
    """Quiet edges, silence, one loud sample, all shapes of loud edges."""
    rng = np.random.default_rng(seed)
    out = {f"s{i}": np.concatenate((np.zeros(rng.integers(0, 9)), rng.normal(size=rng.integers(0, 220)) * rng.random(),
                                    np.zeros(rng.integers(0, 9)))) for i in range(10)}
    lonely = np.zeros(30)
    lonely[17] = -2.0
    return out | {"silent": np.zeros(40), "empty": np.zeros(0), "lonely": lonely, None: rng.normal(size=90),
                  "end": np.append(np.zeros(50), 1.0), "ramp": np.linspace(-1, 1, 111)}


def _cut(signals, pieces, seed=0):
    """``pieces`` segments a signal, some of them empty."""
    rng, rows = np.random.default_rng(seed), []
    for k, x in signals.items():
        at = [0, *sorted(rng.integers(0, len(x) + 1, pieces - 1).tolist()), len(x)]
        rows += [(k, i, [float(v) for v in x[a:b]]) for i, (a, b) in enumerate(zip(at, at[1:]))]
    rng.shuffle(rows)
    return rows


def _frame(spark, rows, partitions=3):
    return spark.createDataFrame([(k, int(i), x) for k, i, x in rows], SCHEMA).repartition(partitions)


def _whole(spark, signals, column):
    df = spark.createDataFrame([(k, [float(v) for v in x]) for k, x in signals.items()], "speaker string, x array<double>")
    return {r["speaker"]: r["y"] for r in column(df).select("speaker", "y").collect()}


def _same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g is None) == (w is None), k
        if w is not None:
            assert len(g) == len(w) and np.allclose(g, w, atol=1e-6, rtol=0), k


@pytest.mark.parametrize("pieces,partitions", [(1, 2), (3, 1), (50, 7)])
def test_cleaning_over_segments(spark, pieces, partitions):
    signals = _signals(pieces)
    frame = _frame(spark, _cut(signals, pieces), partitions)
    chain = SEG.chain_b(RATE, 0.5)
    got = {r["speaker"]: r["signal"] for r in SEG.clean_segments(frame, ["speaker"], chain).collect()}
    _same(got, _whole(spark, signals, lambda df: N.with_clean_signal_b(df, "x", "y", RATE, fc=0.5)))
    chain = SEG.chain_c(RATE, 0.5)
    got = {r["speaker"]: r["signal"] for r in SEG.clean_segments(frame, ["speaker"], chain).collect()}
    want = _whole(spark, signals, lambda df: N.with_clean_signal_c(df, "x", "y", RATE, fc=0.5))
    _same(got, want)
    assert any(w is None for w in want.values()) and any(w and len(w) == 15 * RATE for w in want.values())


def test_a_bad_sample_spoils_what_it_would_spoil_whole(spark):
    x = np.concatenate((np.zeros(10), np.ones(300), np.zeros(10))).tolist()
    signals = {}
    for name, at in (("edge", 2), ("loud", 100), ("behind the cut", 290), ("tail", 318)):
        for bad in (None, float("nan"), float("inf")):
            y = list(x)
            y[at] = bad
            signals[f"{name} {bad}"] = y
    df = spark.createDataFrame(list(signals.items()), "speaker string, x array<double>")
    want = {r["speaker"]: r["y"] for r in N.with_clean_signal_b(df, "x", "y", RATE, fc=0.5).collect()}
    rows = [(k, i, y[i * 40:(i + 1) * 40]) for k, y in signals.items() for i in range(8)]
    chain = SEG.chain_b(RATE, 0.5)
    got = {r["speaker"]: r["signal"] for r in SEG.clean_segments(_frame(spark, rows), ["speaker"], chain).collect()}
    _same(got, want)
    assert got["edge None"] is not None and got["behind the cut None"] is None
    rows = [("a", 0, [1.0] * 20), ("a", 1, None), ("b", 0, [1.0] * 20)]
    got = {r["speaker"]: r["signal"] for r in SEG.clean_segments(_frame(spark, rows), ["speaker"], chain).collect()}
    assert got["a"] is None and len(got["b"]) == 20


@pytest.mark.parametrize("pieces", [1, 3, 50])
@pytest.mark.parametrize("rates", [(8, 11), (8, 5), (8, 16), (8, 8), (3, 100)])
def test_resampling_over_segments(spark, pieces, rates):
    signals = {k: x for k, x in _signals(5).items() if k in ("s1", "s4", "empty", None, "ramp")}
    out = SEG.resample_segments(_frame(spark, _cut(signals, pieces), 4), ["speaker"], *rates)
    assert out.columns == ["speaker", "clip_no", "x"]
    got = {k: [] for k in signals}
    for r in sorted(out.collect(), key=lambda r: r["clip_no"]):
        got[r["speaker"]] += r["x"]
    want = _whole(spark, signals, lambda df: df.withColumn("y", N.resample("x", *rates)))
    assert got == want  # to the last bit


@pytest.mark.parametrize("pieces,partitions", [(1, 1), (3, 4), (50, 3)])
def test_filter_over_segments_equals_the_sample_loop(spark, pieces, partitions):
    rng = np.random.default_rng(pieces)
    signals = {"long": rng.normal(size=4000), "short": rng.normal(size=7), None: rng.normal(size=500), "empty": np.zeros(0)}
    for fc, fs in ((80.0, 16000.0), (0.5, 8.0)):
        out = SEG.highpass_segments(_frame(spark, _cut(signals, pieces, 1), partitions), ["speaker"], fc, fs)
        got = {k: [] for k in signals}
        for r in sorted(out.collect(), key=lambda r: r["clip_no"]):
            got[r["speaker"]] += r["y"]
        for k, x in signals.items():
            want = biquad_loop(x, fc, fs)
            assert len(got[k]) == len(x)
            # rounded to single precision, as the filter is
            assert np.allclose(got[k], want, atol=1e-9, rtol=1e-6), k


def test_state_before_rounding_is_exact():
    """The composition of segment states, in double precision."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=5000)
    for fc, fs in ((80.0, 16000.0), (100.0, 22050.0), (0.5, 8.0)):
        poles, weights = SEG._upper_modes(4, fc, fs)
        want = biquad_loop(x, fc, fs)
        for cuts in ([5000], [1700, 1000, 2300], [100] * 50, [1] * 40 + [4960]):
            state, at, out = np.zeros(len(poles), complex), 0, []
            for n in cuts:
                part = x[at:at + n]
                t = np.arange(1, n + 1)
                out.append(N.highpass_exact(part, fc, fs) + sum(
                    np.real(r * z * np.exp(t * np.log(p))) for p, r, z in zip(poles, weights, state)))
                state = SEG._carried(state, n, poles) + SEG._end_state(part, poles)
                at += n
            assert np.max(np.abs(np.concatenate(out) - want)) < 1e-9


def test_a_hot_signal_spans_partitions(spark):
    """A signal of most segments is filtered across range partitions."""
    rng = np.random.default_rng(9)
    signals = {"hot": rng.normal(size=1500), "b": rng.normal(size=20), "c": rng.normal(size=20)}
    rows = [("hot", i, signals["hot"][i * 5:(i + 1) * 5].tolist()) for i in range(300)]
    rows += [(k, i, signals[k][i * 5:(i + 1) * 5].tolist()) for k in "bc" for i in range(4)]
    out = SEG.highpass_segments(_frame(spark, rows, 6), ["speaker"], 0.5, 8.0).collect()
    got = np.concatenate([r["y"] for r in sorted(out, key=lambda r: r["clip_no"]) if r["speaker"] == "hot"])
    assert np.allclose(got, biquad_loop(signals["hot"], 0.5, 8.0), atol=1e-6)


def test_a_null_segment_ends_its_signal(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 1, None), ("a", 2, [1.0]), ("b", 0, [1.0, float("nan")]), ("b", 1, [1.0]), ("c", 0, [2.0])]
    got = {(r["speaker"], r["clip_no"]): r["y"] for r in SEG.highpass_segments(_frame(spark, rows), ["speaker"], 0.5, 8.0).collect()}
    assert [k for k, y in got.items() if y is None] == [k for k in got if k in {("a", 1), ("a", 2), ("b", 0), ("b", 1)}]
    assert len(got) == 6


def test_no_exchange_before_the_fetch_carries_samples(spark):
    """What is sorted, numbered and summed is narrow: only the joins by
    segment read the samples."""
    frame = _frame(spark, _cut(_signals(1), 5))
    plan = SEG.highpass_segments(frame, ["speaker"], 0.5, 8.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") <= 1  # the frame's own


def test_running_total_and_lookup(spark, monkeypatch):
    rows = [(k, i, (i * 7 + len(str(k))) % 5) for k, n in (("hot", 400), ("a", 3), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(5)
    got = {(r["k"], r["i"]): r["before"] for r in running_total(df, "v", ["i"], ["k"]).collect()}
    want, sums = {}, {}
    for k, i, v in rows:
        want[k, i] = sums.get(k, 0)
        sums[k] = want[k, i] + v
    assert got == want
    table = spark.createDataFrame([("hot", 1), (None, 2)], "k string, w int")
    for limit in (100, 0):
        monkeypatch.setattr(LK, "BROADCAST_ROWS", limit)
        out = LK.lookup(df, table, ["k"], F.col("i"))
        assert sorted(map(str, out.columns)) == ["i", "k", "v", "w"]
        assert {(r["k"], r["w"]) for r in out.collect()} == {("hot", 1), ("a", None), (None, 2)} and out.count() == 423
