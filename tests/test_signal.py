"""Filters, spectra and features against literal formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwise.functions import features as X
from epochwise.functions import filters as H
from epochwise.operators import signal as G
from epochwise.operators.epochs import epoch_samples


def direct_filter(b, a, x):
    """Difference equation, first row by row."""
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k)
    return y


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(0)
    tracks = {1: rng.normal(size=(3000, 2)), 2: rng.normal(size=(90, 2))}
    rows = [(c, i, float(x[0]), float(x[1])) for c, t in tracks.items() for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "case_id long, idx long, ch1 double, ch2 double")
    return tracks, G.to_blocks(df, 64, 128).cache()


def test_band_pass_design():
    b, a = H.design_butterworth(128, 0.5, 30, 4)
    def gain(f):
        z = np.exp(-2j * np.pi * f / 128)
        return abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))
    assert len(b) == len(a) == 9
    assert gain(5.0) == pytest.approx(1, abs=1e-4)
    assert gain(0.5) == pytest.approx(math.sqrt(0.5), rel=1e-6) and gain(30.0) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    assert gain(0.01) < 1e-5 and gain(63) < 1e-5


def test_recursion_is_the_difference_equation():
    b, a = H.design_butterworth(64, 2, 20, 2)
    x = np.random.default_rng(1).normal(size=50)
    assert np.allclose(H.recursion(b, a, x[:, None], np.zeros((len(a) - 1, 1)))[:, 0], direct_filter(b, a, x))


def test_filter_in_blocks_equals_whole_track(wave):
    tracks, blocks = wave
    b, a = H.design_butterworth(64, 2, 20, 4)
    out = G.to_samples(G.filter_waveform(blocks, 64, 128, 2, 20, 4), 128).toPandas()
    for case, x in tracks.items():
        want = H.zero_phase_exact(b, a, x, True, True)
        got = out[out.case_id == case].sort_values("idx")
        assert len(got) == len(x)
        assert np.abs(got[["ch1", "ch2"]].to_numpy() - want).max() < 1e-7


def test_filter_keeps_phase_and_gain_in_band(spark):
    t = np.arange(4000) / 64
    x = np.sin(2 * np.pi * 8 * t)
    df = spark.createDataFrame([(1, i, float(v), 1.0) for i, v in enumerate(x)], "case_id long, idx long, ch1 double, ch2 double")
    got = G.to_samples(G.filter_waveform(G.to_blocks(df, 64, 256), 64, 256, 2, 20, 4), 256).orderBy("idx").toPandas()
    inner = slice(500, 3500)
    assert np.abs(got.ch1.to_numpy()[inner] - x[inner]).max() < 1e-3
    assert np.abs(got.ch2.to_numpy()[inner]).max() < 1e-6
    with pytest.raises(ValueError):
        G.filter_waveform(G.to_blocks(df, 64, 256), 64, 256, method="other")


def welch_loop(x, fs, n):
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    out = []
    for s in range(0, len(x) - n + 1, n - n // 2):
        seg = (x[s:s + n] - x[s:s + n].mean()) * w
        p = np.array([abs(sum(seg[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))) ** 2 for k in range(n // 2 + 1)])
        p /= fs * (w**2).sum()
        p[1:-1 if n % 2 == 0 else None] *= 2
        out.append(p)
    return np.mean(out, axis=0)


def test_welch_epoch_and_track(spark, wave):
    tracks, blocks = wave
    x = tracks[2][:, 0]
    df = spark.createDataFrame([(x.tolist(),), (x[:20].tolist(),)], "eeg array<double>").select(G.welch(F.col("eeg"), 64, 0.5).alias("s"))
    long, short = [r["s"] for r in df.collect()]
    assert np.allclose([q["p"] for q in long], welch_loop(x, 64, 32))
    assert [q["f"] for q in long] == [2.0 * k for k in range(17)]
    assert np.allclose([q["p"] for q in short], welch_loop(x[:20], 64, 20))
    tr = G.track_spectrum(blocks, 64, 128, 2, 0.5).orderBy("case_id", "freq_hz").toPandas()
    for case in (1, 2):
        assert np.allclose(tr[tr.case_id == case].psd, welch_loop(tracks[case][:, 1], 64, 32))


def test_spectrum_area_is_the_power(spark):
    x = np.random.default_rng(5).normal(size=64)
    df = spark.createDataFrame([(x.tolist(),)], "eeg array<double>").select(G.welch(F.col("eeg"), 64, 1).alias("s"))
    p = np.array([q["p"] for q in df.first()["s"]])
    w = G.hann(64)
    y = (x - x.mean()) * w
    assert p.sum() == pytest.approx((y**2).sum() / (w**2).sum())


def sample_entropy_loop(x, m, tol):
    n, r = len(x) - m, tol * np.std(x)
    a = b = 0
    for i in range(n):
        for j in range(i + 1, n):
            if max(abs(x[i + k] - x[j + k]) for k in range(m)) < r:
                b += 1
                a += abs(x[i + m] - x[j + m]) < r
    return -math.log(a / b)


def fuzzy_loop(x, m, r, n):
    count, phis = len(x) - m, []
    for d in (m, m + 1):
        s = 0.0
        for i in range(count):
            for j in range(count):
                if i != j:
                    u, v = np.array(x[i:i + d]), np.array(x[j:j + d])
                    s += math.exp(-(np.abs((u - u.mean()) - (v - v.mean())).max() ** n) / (r * np.std(x)))
        phis.append(s / (count * (count - 1)))
    return math.log(phis[0] / phis[1])


def permutation_loop(x, order, delay):
    from collections import Counter

    c = Counter(tuple(np.argsort([x[i + j * delay] for j in range(order)], kind="stable")) for i in range(len(x) - (order - 1) * delay))
    q = np.array(list(c.values())) / sum(c.values())
    return -(q * np.log2(q)).sum()


def test_entropies_against_loops(spark):
    rng = np.random.default_rng(2)
    xs = [rng.normal(size=80), np.round(rng.normal(size=300), 1)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "i int, eeg array<double>")
    e = F.col("eeg")
    out = df.select("i", X.sample_entropy(e).alias("s"), X.fuzzy_entropy(e).alias("f"), X.permutation_entropy(e).alias("p"),
                    X.permutation_entropy(e, 4, 2).alias("p4")).orderBy("i").collect()
    for r, x in zip(out, xs):
        assert r["s"] == pytest.approx(sample_entropy_loop(x, 2, 0.2))
        assert r["f"] == pytest.approx(fuzzy_loop(x, 2, 0.2, 2))
        assert r["p"] == pytest.approx(permutation_loop(x, 3, 1))
        assert r["p4"] == pytest.approx(permutation_loop(x, 4, 2))


def test_degenerate_spectra(spark):
    schema = "psd array<struct<f:double,p:double>>"
    flat = [(float(f), 0.0) for f in range(5)]
    df = spark.createDataFrame([(flat,)], schema)
    p = F.col("psd")
    r = df.select(X.shannon_entropy(p).alias("h"), X.spectral_skewness(p).alias("s"), X.band_power(p).alias("b")).first()
    assert r["h"] is None and r["s"] is None and set(r["b"].asDict().values()) == {0.0}
    with pytest.raises(ValueError):
        X.band_power(p, normalize_to="other")


def test_registry_merges_defaults():
    reg = X.FEATURES
    assert reg["permutation_entropy"].defaults["order"] == 3
    with pytest.raises(ValueError, match="not found"):
        reg["unknown"]


def test_epoch_slices(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(500)], "case_id long, idx long, ch1 double, ch2 double")
    blocks = G.to_blocks(df, 100, 64)
    ep = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0), (1, 1.5, 2.5), (1, 4.5, 5.5)], "case_id long, start double, end double")
    got = {r["start"]: r["eeg"] for r in epoch_samples(ep, blocks, 100, 64).collect()}
    assert got[1.0] == [float(i) for i in range(100, 200)] and got[3.0] == [float(i) for i in range(300, 400)]
    assert got[1.5] == [float(i) for i in range(150, 250)] and got[4.5] == [float(i) for i in range(450, 500)]
    assert 4.5 not in {r["start"] for r in epoch_samples(ep, blocks, 100, 64, complete=True).collect()}


def test_normalisation_errors(wave):
    _, blocks = wave
    with pytest.raises(Exception, match="non-negative"):
        G.normalize_waveform(blocks, "log").collect()
    with pytest.raises(ValueError):
        G.normalize_waveform(blocks, "clip", feature_type="entropy")
    with pytest.raises(ValueError):
        G.normalize_waveform(blocks, "nope")


def test_filter_memory_does_not_grow_with_the_batch():
    import tracemalloc

    import pandas as pd

    b, a = H.design_butterworth(32, 2.0, 12.0, 4)
    halo = H.settle_samples(a)

    def peak(n):
        rng = np.random.default_rng(0)
        x = pd.Series(list(rng.normal(size=(n, 128 + 2 * halo))))
        same = lambda v: pd.Series([v] * n)
        tracemalloc.start()
        out = G.filter_pieces(b, a, x, x, same(halo), same(128), same(False), same(False))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.allclose(out.ch1.iloc[-1], H.zero_phase_spectral(b, a, x.iloc[-1][:, None])[halo:halo + 128, 0])
        return most

    # The result itself takes 2 kB a piece; the spectra of a piece take ten times that.
    assert peak(3000) - peak(1000) < 2000 * 4000
