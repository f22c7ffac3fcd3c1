"""Epoch features as column expressions, and their registry.

A feature takes an array column and keyword parameters and gives a column. Spectral features take
``array<struct<f, p>>``, time-domain features ``array<double>``. Everything but sample and fuzzy
entropy is built from higher-order functions; those two compare all pairs of templates of an epoch
and run as Arrow UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from epochwise.params import BANDS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name an intermediate result, so that it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def rescale_range(t: Column, a: float, b: float, c: float, d: float) -> Column:
    """Linear map of [a, b] to [c, d]."""
    if not (b > a and d > c):
        raise ValueError("ranges must not be empty or inverted")
    return t if (a, b) == (c, d) else F.lit(float(c)) + (t - F.lit(float(a))) * ((d - c) / (b - a))


def scaled_tanh(x: Column, center: float = 0.0, sensitivity: float = 1.0, out_min: float = -1.0, out_max: float = 1.0) -> Column:
    """Tanh of the centred and scaled value, mapped to [out_min, out_max]."""
    return rescale_range(F.tanh((x - center) / sensitivity), -1, 1, out_min, out_max)


def deviation_from_center(x: Column, a: float, b: float) -> Column:
    """0 in the middle of [a, b], 1 at its edges."""
    return 2 * F.abs(x - (a + b) / 2) / (b - a)


def bounded(x: Column, normalize: bool, method: str, low: float, high: float) -> Column:
    if not normalize:
        return x
    if method == "tanh":
        return scaled_tanh(x, out_min=low, out_max=high)
    if method == "clip":
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
    raise ValueError(f"{method!r} is no way to normalise a feature")


def area(points: Column) -> Column:
    """Trapezoid rule over consecutive points of the array."""

    def strips(q: Column) -> Column:
        n = F.greatest(F.size(q) - 1, F.lit(0))
        return total(F.zip_with(F.slice(q, F.lit(1), n), F.slice(q, F.lit(2), n), lambda l, r: (r.p + l.p) / 2 * (r.f - l.f)))

    return let(points, strips)


def band_power(psd: Column, bands: Mapping[str, tuple[float, float]] = BANDS, normalize_to: str = "bands") -> Column:
    """K1: struct with the share of each band.

    ``bands`` integrates over the union of the bands (gaps between bands included), ``total`` over
    all frequencies; a share is 0 when the denominator is not positive.
    """
    def inside(x: Column, lo: float, hi: float) -> Column:
        return (x.f >= float(lo)) & (x.f < float(hi))

    if normalize_to == "total":
        whole = area(psd)
    elif normalize_to == "bands":
        def any_band(x: Column) -> Column:
            hit = F.lit(False)
            for lo, hi in bands.values():
                hit = hit | inside(x, lo, hi)
            return hit

        whole = area(F.filter(psd, any_band))
    else:
        raise ValueError("normalize_to is total or bands")
    def part(lo: float, hi: float) -> Column:
        return area(F.filter(psd, lambda x: inside(x, lo, hi)))

    parts = [part(lo, hi).alias(name) for name, (lo, hi) in bands.items()]

    def shares(s: Column) -> Column:
        return F.struct(*[F.when(s["_whole"] > 0, s[n] / s["_whole"]).otherwise(0.0).alias(n) for n in bands])

    return let(F.struct(whole.alias("_whole"), *parts), shares)


def shannon_entropy(psd: Column, normalize: bool = False) -> Column:
    """K2: entropy in bits of the power shares; null for an empty spectrum."""
    def entropy(t: Column) -> Column:
        positive = F.filter(F.transform(psd, lambda x: F.try_divide(x.p, t)), lambda q: q > 0)
        h = F.aggregate(positive, F.lit(0.0), lambda a, q: a - q * F.log2(q))
        if normalize:
            n = F.size(positive)
            h = F.when(n > 1, h / F.log2(n.cast("double"))).otherwise(h)
        return F.when(t != 0, h)

    return let(total(F.transform(psd, lambda x: x.p)), entropy)


def _spectral_moment(psd: Column, k: int) -> Column:
    def about(m: Column) -> Column:
        def central(power: int) -> Column:
            return F.aggregate(psd, F.lit(0.0), lambda a, x: a + x.p / m.t * F.pow(x.f - m.mean, F.lit(float(power))))

        return F.when(m.t != 0, F.try_divide(central(k), F.pow(F.sqrt(central(2)), F.lit(float(k)))))

    def mean(t: Column) -> Column:
        weighted = F.aggregate(psd, F.lit(0.0), lambda a, x: a + x.p * x.f)
        return F.struct(F.when(t != 0, t).alias("t"), F.try_divide(weighted, t).alias("mean"))

    return let(let(total(F.transform(psd, lambda x: x.p)), mean), about)


def spectral_skewness(psd: Column, normalize: bool = False, n_method: str = "clip", lower_bound: float = 0, upper_bound: float = 1) -> Column:
    """K3: third standardised moment of the frequency under the power distribution."""
    return bounded(_spectral_moment(psd, 3), normalize, n_method, lower_bound, upper_bound)


def spectral_kurtosis(psd: Column, normalize: bool = False, n_method: str = "clip", lower_bound: float = 0, upper_bound: float = 1) -> Column:
    """K4: fourth standardised moment (not excess)."""
    return bounded(_spectral_moment(psd, 4), normalize, n_method, lower_bound, upper_bound)


def mean(eeg: Column) -> Column:
    """K5"""
    return F.try_divide(total(eeg), F.size(eeg).cast("double"))


def variance(eeg: Column) -> Column:
    """K6: population variance."""
    return let(mean(eeg), lambda m: F.try_divide(F.aggregate(eeg, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), F.size(eeg).cast("double")))


def amplitude(eeg: Column) -> Column:
    """K7: peak to peak."""
    return F.array_max(eeg) - F.array_min(eeg)


def permutation_entropy(eeg: Column, order: int = 3, delay: int = 1, normalize: bool = False) -> Column:
    """K9: entropy in bits of the ordinal patterns (Bandt and Pompe 2002); equal values rank by position.

    A pattern is coded by the outcomes of its pairwise comparisons, which determine the ranking.
    """
    span = (order - 1) * delay

    def code(i: Column) -> Column:
        c, bit = F.lit(0), 1
        for j in range(order):
            for k in range(j + 1, order):
                less = F.get(eeg, i + j * delay) <= F.get(eeg, i + k * delay)
                c = c + F.when(less, F.lit(bit)).otherwise(F.lit(0))
                bit *= 2
        return c

    def entropy(codes: Column) -> Column:
        n = F.size(codes).cast("double")
        shares = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda x: x == c)) / n)
        h = F.aggregate(shares, F.lit(0.0), lambda a, q: a - q * F.log2(q))
        return h / math.log2(math.factorial(order)) if normalize else h

    positions = F.sequence(F.lit(0), F.size(eeg) - 1 - span)
    return F.when(F.size(eeg) > span, let(F.transform(positions, code), entropy))


def _pair_blocks(n: int, size: int = 256):
    for at in range(0, n, size):
        yield np.arange(at, min(at + size, n))


def sample_entropy_of(x: np.ndarray, emb_dim: int, tolerance: float) -> float | None:
    n = len(x) - emb_dim
    if n < 2:
        return None
    r = tolerance * np.std(x)
    close_m = close_m1 = 0
    for rows in _pair_blocks(n):
        later = np.arange(n)[None, :] > rows[:, None]
        near = later
        for k in range(emb_dim):
            near = near & (np.abs(x[rows + k][:, None] - x[k:k + n][None, :]) < r)
        close_m += int(near.sum())
        last = np.abs(x[rows + emb_dim][:, None] - x[emb_dim:emb_dim + n][None, :]) < r
        close_m1 += int((near & last).sum())
    return -math.log(close_m1 / close_m) if close_m and close_m1 else None


def fuzzy_entropy_of(x: np.ndarray, m: int, r: float, n: int) -> float | None:
    count = len(x) - m
    width = r * np.std(x)
    if count < 2 or width == 0:
        return None
    sums = []
    for dim in (m, m + 1):
        t = np.stack([x[k:k + count] for k in range(dim)], axis=1)
        t = t - t.mean(axis=1, keepdims=True)
        s = 0.0
        for rows in _pair_blocks(count):
            d = np.abs(t[rows][:, None, :] - t[None, :, :]).max(axis=2)
            s += np.exp(-(d**n) / width).sum()
        sums.append((s - count) / (count * (count - 1)))
    return math.log(sums[0] / sums[1]) if sums[0] > 0 and sums[1] > 0 else None


def _epoch_udf(fn: Callable[[np.ndarray], float | None]):
    def run(eeg: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else fn(np.asarray(e, dtype=float)) for e in eeg], dtype="float64")

    return F.pandas_udf(run, "double")


def sample_entropy(eeg: Column, emb_dim: int = 2, tolerance: float = 0.2) -> Column:
    """K8: sample entropy (Richman and Moorman 2000).

    ``N - emb_dim`` templates for both lengths, Chebyshev distance strictly below
    ``tolerance * std``, self matches excluded; null where no pair matches.
    """
    return _epoch_udf(lambda x: sample_entropy_of(x, emb_dim, tolerance))(eeg)


def fuzzy_entropy(eeg: Column, m: int = 2, r: float = 0.2, n: int = 2) -> Column:
    """Fuzzy entropy (Chen et al. 2007) with membership ``exp(-d**n / (r * std))`` on centred templates."""
    return _epoch_udf(lambda x: fuzzy_entropy_of(x, m, r, n))(eeg)


@dataclass(frozen=True)
class Feature:
    """One registered feature: function, the array it reads, and its default parameters."""

    name: str
    fn: Callable[..., Column]
    source: str
    defaults: Mapping[str, object] = field(default_factory=dict)

    def __call__(self, column: Column | str, **overrides) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        return self.fn(column, **{**self.defaults, **overrides})


class Registry(dict):
    """O1: features by key."""

    def register(self, name: str, fn: Callable[..., Column], source: str, **defaults) -> None:
        if source not in ("eeg", "psd"):
            raise ValueError("source must be 'eeg' or 'psd'")
        self[name] = Feature(name, fn, source, defaults)

    def __missing__(self, name: str):
        raise ValueError(f"Feature '{name}' not found.")

    def columns(self, names, overrides: Mapping[str, Mapping[str, object]] | None = None) -> list[Column]:
        """All named features as columns of one projection; a struct result becomes several columns."""
        overrides = overrides or {}
        out = []
        for name in names:
            f = self[name]
            c = f(f.source, **overrides.get(name, {}))
            out.append(c.alias(name))
        return out


FEATURES = Registry()
FEATURES.register("bandpower", band_power, "psd", normalize_to="bands")
FEATURES.register("shannon_entropy", shannon_entropy, "psd", normalize=False)
FEATURES.register("spectral_skewness", spectral_skewness, "psd", normalize=False, n_method="clip", lower_bound=0, upper_bound=1)
FEATURES.register("spectral_kurtosis", spectral_kurtosis, "psd", normalize=False, n_method="clip", lower_bound=0, upper_bound=1)
FEATURES.register("mean", mean, "eeg")
FEATURES.register("variance", variance, "eeg")
FEATURES.register("amplitude", amplitude, "eeg")
FEATURES.register("sample_entropy", sample_entropy, "eeg", emb_dim=2, tolerance=0.2)
FEATURES.register("permutation_entropy", permutation_entropy, "eeg", order=3, delay=1, normalize=False)
FEATURES.register("fuzzy_entropy", fuzzy_entropy, "eeg", m=2, r=0.2, n=2)
