"""Waveforms and spectra.

Waveform table: ``case_id, block, fs, ch1 array<double>, ch2 array<double>`` where block ``b`` holds
samples ``[b * block_len, (b + 1) * block_len)``. No task ever holds a whole track.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.functions.features import FEATURES, Registry, total
from epochwise.functions.filters import design_butterworth, settle_samples, zero_phase_exact, zero_phase_spectral
from epochwise.operators.ordered import cumulative, join_small
from epochwise.session import materialize

KEYS = ["case_id", "start", "end"]


def to_blocks(samples: DataFrame, fs: int, block_len: int) -> DataFrame:
    """Rows ``case_id, idx, ch1, ch2`` packed into blocks of at most ``block_len`` samples."""
    packed = samples.withColumn("block", F.floor(F.col("idx") / block_len)).groupBy("case_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", "ch1", "ch2"))).alias("_s")
    )
    return packed.select(
        "case_id", "block", F.lit(fs).alias("fs"),
        F.transform("_s", lambda s: s.ch1).alias("ch1"), F.transform("_s", lambda s: s.ch2).alias("ch2"),
    )


def to_samples(blocks: DataFrame, block_len: int) -> DataFrame:
    """Inverse of :func:`to_blocks`."""
    return blocks.select("case_id", "block", F.posexplode(F.arrays_zip("ch1", "ch2")).alias("_i", "_s")).select(
        "case_id", (F.col("block") * block_len + F.col("_i")).alias("idx"), F.col("_s.ch1").alias("ch1"), F.col("_s.ch2").alias("ch2")
    )


def track_lengths(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("case_id").agg(F.sum(F.size("ch1").cast("long")).alias("n_samples"))


def with_halo(blocks: DataFrame, block_len: int, before: int, after: int, channels: Sequence[str] = ("ch1", "ch2")) -> DataFrame:
    """Each block with ``before`` samples of what precedes and ``after`` of what follows it.

    Every block is sent to the blocks that need a part of it, cut to that part; the group of a block
    holds a fixed small number of pieces. Adds ``own_offset`` (position of the own samples),
    ``own_len``, ``at_start`` and ``at_end`` (block touches that end of the track).
    """
    back, ahead = -(-after // block_len), -(-before // block_len)
    ends = blocks.groupBy("case_id").agg(F.max("block").alias("_last"))
    reach = F.sequence(F.greatest(F.col("block") - back, F.lit(0)), F.least(F.col("block") + ahead, F.col("_last")))
    sent = blocks.join(ends, "case_id").withColumn("_t", F.explode(reach))
    base = F.col("block") * block_len
    lo = F.greatest(F.col("_t") * block_len - before - base, F.lit(0))
    hi = F.least((F.col("_t") + 1) * block_len + after - base, F.size(channels[0]).cast("long"))
    parts = [F.slice(c, (lo + 1).cast("int"), (hi - lo).cast("int")).alias(c) for c in channels]
    pieces = sent.filter(hi > lo).select("case_id", "fs", "_t", "_last", F.struct("block", *parts).alias("_p"))
    own = F.col("_p.block") == F.col("_t")
    gathered = pieces.groupBy("case_id", "_t").agg(
        F.first("fs").alias("fs"), F.max("_last").alias("_last"), F.array_sort(F.collect_list("_p")).alias("_p"),
        F.sum(F.when(F.col("_p.block") < F.col("_t"), F.size(f"_p.{channels[0]}")).otherwise(0)).cast("int").alias("own_offset"),
        F.sum(F.when(own, F.size(f"_p.{channels[0]}")).otherwise(0)).cast("int").alias("own_len"),
    )
    return gathered.filter("own_len > 0").select(
        "case_id", F.col("_t").alias("block"), "fs",
        *[F.flatten(F.col(f"_p.{c}")).alias(c) for c in channels],
        "own_offset", "own_len", (F.col("_t") * block_len <= before).alias("at_start"),
        ((F.col("_last") - F.col("_t")) * block_len <= after).alias("at_end"),
    )


FILTERED = 1 << 18  # samples of both channels that are filtered at once


def filter_pieces(b: np.ndarray, a: np.ndarray, ch1: pd.Series, ch2: pd.Series, off: pd.Series, n: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Own samples of each piece, filtered. Pieces of equal length go together, one column per piece and channel, ``FILTERED`` samples at a time."""
    out: list = [None] * len(ch1)
    groups: dict[tuple, list[int]] = {}
    pieces, own = list(zip(ch1, ch2)), list(zip(off, n))
    for i, ends in enumerate(zip(first, last)):
        groups.setdefault((len(pieces[i][0]), *map(bool, ends)), []).append(i)
    for (length, start, end), rows in groups.items():
        step = max(1, FILTERED // (2 * max(length, 1)))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            x = np.stack([np.asarray(c, dtype=float) for i in part for c in pieces[i]], axis=1)
            y = zero_phase_exact(b, a, x, start, end) if start or end else zero_phase_spectral(b, a, x)
            for j, i in enumerate(part):
                # Copies: a view would keep the halo of all pieces of the step.
                out[i] = y[own[i][0]:own[i][0] + own[i][1], 2 * j:2 * j + 2].T.copy()
    return pd.DataFrame({"ch1": [o[0] for o in out], "ch2": [o[1] for o in out]})


def filter_waveform(
    blocks: DataFrame, fs: int, block_len: int, low: float = 0.5, high: float = 30.0, order: int = 4,
    method: str = "butterworth", halo: int | None = None,
) -> DataFrame:
    """Zero-phase Butterworth band-pass of both channels.

    Interior blocks multiply the spectrum by the squared response; blocks whose halo reaches a true
    end of the track run the forward-backward recursion with odd reflection there. The halo is as
    long as the slowest pole needs to decay to 1e-10.
    """
    if method != "butterworth":
        raise ValueError(f"no filter is called {method!r}")
    b, a = design_butterworth(fs, low, high, order)
    halo = settle_samples(a) if halo is None else halo

    def run(ch1: pd.Series, ch2: pd.Series, off: pd.Series, n: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        return filter_pieces(b, a, ch1, ch2, off, n, first, last)

    udf = F.pandas_udf(run, "ch1 array<double>, ch2 array<double>")
    h = with_halo(blocks, block_len, halo, halo)
    done = h.withColumn("_y", udf("ch1", "ch2", "own_offset", "own_len", "at_start", "at_end"))
    return done.select("case_id", "block", "fs", F.col("_y.ch1").alias("ch1"), F.col("_y.ch2").alias("ch2"))


def _map_channels(df: DataFrame, fn) -> DataFrame:
    def mapped(c: str) -> Column:
        return F.transform(c, lambda x: fn(x, c)).alias(c)

    return df.select("case_id", "block", "fs", mapped("ch1"), mapped("ch2"))


def centre_waveform(blocks: DataFrame) -> DataFrame:
    """Subtract the mean of each channel of a case."""
    n = F.sum(F.size("ch1").cast("double"))
    means = blocks.groupBy("case_id").agg((F.sum(total(F.col("ch1"))) / n).alias("_m1"), (F.sum(total(F.col("ch2"))) / n).alias("_m2"))
    return _map_channels(blocks.join(means, "case_id"), lambda x, c: x - F.col(f"_m{c[-1]}"))


def normalize_waveform(blocks: DataFrame, method: str, block_len: int | None = None, feature_type: str | None = None, per_channel: bool = False) -> DataFrame:
    """Zscore, tanh_zscore, minmax, quantile, tanh, log, clip.

    The first four take both channels of a case together, or each for itself with ``per_channel``.
    """
    if method == "tanh":
        return _map_channels(blocks, lambda x, c: F.tanh(x))
    if method == "clip":
        # Clipping range per feature type.
        limits = {"skewness": (-2.0, 2.0), "kurtosis": (0.0, 10.0)}
        if feature_type not in limits:
            raise ValueError(f"there are no clip limits for {feature_type!r}")
        lo, hi = limits[feature_type]
        return _map_channels(blocks, lambda x, c: F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    if method == "log":
        error = F.raise_error(F.lit("the logarithm is for signals that are non-negative throughout")).cast("double")
        return _map_channels(blocks, lambda x, c: F.when(x < 0, error).otherwise(F.log1p(x)))
    if method == "quantile":
        if block_len is None:
            raise ValueError("quantile normalisation needs block_len")
        return _quantile(blocks, block_len, per_channel)
    if method not in ("zscore", "tanh_zscore", "minmax"):
        raise ValueError(f"{method!r} is no way to normalise a waveform")
    sources = {c: [c] if per_channel else ["ch1", "ch2"] for c in ("ch1", "ch2")}
    stats = None
    for c, own in sources.items() if per_channel else [("ch1", sources["ch1"])]:
        v = blocks.select("case_id", F.explode(F.concat(*own)).alias("v"))
        one = v.groupBy("case_id").agg(F.avg("v").alias(f"_m_{c}"), F.stddev_pop("v").alias(f"_s_{c}"), F.min("v").alias(f"_lo_{c}"), F.max("v").alias(f"_hi_{c}"))
        stats = one if stats is None else stats.join(one, "case_id")
    joined = blocks.join(stats, "case_id")

    def scale(x: Column, c: str) -> Column:
        m, sd, lo, hi = (F.col(f"_{k}_{c if per_channel else 'ch1'}") for k in ("m", "s", "lo", "hi"))
        if method == "minmax":
            return F.try_divide(x - lo, hi - lo)
        z = F.try_divide(x - m, sd)
        return F.tanh(z) if method == "tanh_zscore" else z

    return _map_channels(joined, scale)


RANGE = 500_000  # samples of a stretch of blocks, and distinct values of a range, that meet in one group


def _quantile(blocks: DataFrame, block_len: int, per_channel: bool) -> DataFrame:
    """Mean of the lowest and highest 0-based rank of a value, over n - 1.

    Ranks are counted per distinct value and kept in ranges of bounded size. Blocks stay whole: a stretch of blocks meets each range
    of its case and looks its samples up; the arrays that come back, one a range, are laid over each other. So a value
    that fills a third of a case is one entry of a range, and no sample is moved on its own.
    """
    tall = blocks.select("case_id", "block", "fs", F.explode(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("x")) for c in ("ch1", "ch2")])).alias("_c"))
    own = F.col("_c.ch") if per_channel else F.lit("both")
    tall = tall.select("case_id", "block", "fs", own.alias("_k"), F.col("_c.ch").alias("ch"), F.col("_c.x").alias("x"), F.floor(F.col("block") * block_len / RANGE).alias("_part"))
    keys = ["case_id", "_k"]
    c = cumulative(tall.select(*keys, F.explode("x").alias("v")), keys, "v", {"n": F.count(F.lit(1))})
    q = F.try_divide(F.col("n_below") + (F.col("n") - 1) / 2, F.col("n_total") - 1.0)
    values = materialize(c.select(*keys, F.floor(F.col("n_below") / RANGE).alias("_range"), "v", q.alias("q")), "ranks")
    ranges = values.select(*keys, "_range").distinct()
    parts = tall.select(*keys, "_part").distinct()
    left = tall.join(ranges, keys, "left").fillna(0, ["_range"])
    right = values.join(parts, keys).select(*[F.col(k).alias(f"{k}_") for k in (*keys, "_range", "_part")], "v", "q")

    def look_up(blocks: pa.Table, table: pa.Table) -> pa.Table:
        v, q = (table[c].to_numpy(zero_copy_only=False) for c in ("v", "q"))
        order = np.argsort(v, kind="stable")
        v, q = v[order], q[order]
        x = blocks["x"].combine_chunks()
        flat = x.flatten()
        got = flat.to_numpy(zero_copy_only=False).astype(float)
        at = np.minimum(np.searchsorted(v, got), max(len(v) - 1, 0))
        hit = ((v[at] == got) | (np.isnan(v[at]) & np.isnan(got))) if len(v) else np.zeros(len(got), bool)
        hit &= flat.is_valid().to_numpy(zero_copy_only=False)
        found = pa.array(np.where(hit, q[at] if len(v) else np.nan, np.nan), from_pandas=True)
        sizes = np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int32)
        return pa.table({c: blocks[c] for c in ("case_id", "block", "fs", "ch")} | {"y": pa.ListArray.from_arrays(pa.array(sizes), found)})

    kinds = ", ".join(f"{c} {t}" for c, t in tall.dtypes if c in ("case_id", "block", "fs", "ch")) + ", y array<double>"
    found = left.groupBy(*keys, "_range", "_part").cogroup(right.groupBy(*[f"{k}_" for k in (*keys, "_range", "_part")])).applyInArrow(look_up, kinds)

    def laid_over(c: str) -> Column:
        none = F.array().cast("array<double>")
        return F.aggregate(F.collect_list(F.when(F.col("ch") == c, F.col("y"))), none, lambda a, y: F.when(F.size(a) == 0, y).otherwise(F.zip_with(a, y, lambda p, r: F.coalesce(p, r)))).alias(c)

    return found.groupBy("case_id", "block", "fs").agg(laid_over("ch1"), laid_over("ch2"))


def zscore_columns(df: DataFrame, columns: Sequence[str], sample: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Columns as z-scores (population spread) of the table itself or of another sample.

    ``by``: experiment columns; the sample carries them and each row of ``df`` is normalised once per
    experiment it belongs to.
    """
    source = df if sample is None else sample
    stats = source.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    joined = join_small(df, stats, [c for c in by])
    return joined.select(*[
        F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def segment_power(x: np.ndarray, fs: float) -> np.ndarray:
    """One-sided power density of each row of ``x``: mean removed, Hann window."""
    n = x.shape[1]
    w = hann(n)
    power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (fs * (w**2).sum())
    power[:, 1:(-1 if n % 2 == 0 else None)] *= 2
    return power


def welch(eeg: Column | str, fs: float, seconds: float = 2) -> Column:
    """Welch spectrum of an epoch as ``array<struct<f, p>>``.

    Segments of ``seconds``, half overlapping; an epoch shorter than a segment is one segment.
    """
    nperseg = int(seconds * fs)

    def run(series: pd.Series) -> pd.DataFrame:
        freq, power = [None] * len(series), [None] * len(series)
        by_length: dict[int, list[int]] = {}
        for i, e in enumerate(series):
            if e is not None and len(e):
                by_length.setdefault(len(e), []).append(i)
        for length, rows in by_length.items():
            n = min(nperseg, length)
            step = n - n // 2
            starts = range(0, length - n + 1, step)
            axis = np.arange(n // 2 + 1) * (fs / n)
            # Epochs of equal length are transformed together, a bounded number at a time.
            for at in range(0, len(rows), 256):
                part = rows[at:at + 256]
                x = np.stack([np.asarray(series.iloc[i], dtype=float) for i in part])
                segs = np.stack([x[:, s:s + n] for s in starts], axis=1)
                p = segment_power(segs.reshape(-1, n), fs).reshape(len(part), len(starts), -1).mean(axis=1)
                for i, row in zip(part, p):
                    freq[i], power[i] = axis, row
        return pd.DataFrame({"f": freq, "p": power})

    s = F.pandas_udf(run, "f array<double>, p array<double>")(eeg)
    return F.element_at(F.transform(F.array(s), lambda q: F.arrays_zip(q.f.alias("f"), q.p.alias("p"))), 1)


def epoch_spectra(epochs: DataFrame, fs: float, seconds: float = 2, method: str = "welch") -> DataFrame:
    """Spectrum column ``psd`` for epochs with samples ``eeg``."""
    if method != "welch":
        raise ValueError(f"no spectrum method is called {method!r}")
    return epochs.withColumn("psd", welch(F.col("eeg"), fs, seconds))


def long_spectra(spectra: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per epoch and frequency."""
    return spectra.select(*keys, F.explode("psd").alias("_q")).select(*keys, F.col("_q.f").alias("freq_hz"), F.col("_q.p").alias("psd"))


def track_spectrum(blocks: DataFrame, fs: int, block_len: int, channel: int = 1, seconds: float = 2, by: Sequence[str] = ()) -> DataFrame:
    """Welch spectrum of whole tracks: segments are handled block by block and summed per frequency."""
    if channel not in (1, 2):
        raise ValueError(f"there are channels 1 and 2, not {channel}")
    n = int(seconds * fs)
    step = n - n // 2
    if block_len % step:
        raise ValueError("block_len must be a multiple of the segment step")
    col = f"ch{channel}"

    def run(series: pd.Series, own: pd.Series) -> pd.DataFrame:
        power, count = [], []
        for x, length in zip(series, own):
            x = np.asarray(x, dtype=float)
            starts = [s for s in range(0, int(length), step) if s + n <= len(x)]
            segs = np.stack([x[s:s + n] for s in starts]) if starts else np.empty((0, n))
            power.append(segment_power(segs, fs).sum(axis=0) if starts else np.zeros(n // 2 + 1))
            count.append(len(starts))
        return pd.DataFrame({"p": power, "n": count})

    udf = F.pandas_udf(run, "p array<double>, n int")
    own = blocks.select("case_id", "block", "fs", col)
    h = with_halo(own, block_len, 0, n - step, [col]).withColumn("_r", udf(col, "own_len"))
    bins = h.select("case_id", F.col("_r.n").alias("_n"), F.posexplode("_r.p").alias("_k", "_p"))
    return bins.groupBy("case_id", "_k").agg((F.try_divide(F.sum("_p"), F.sum("_n").cast("double"))).alias("psd")).select(
        "case_id", (F.col("_k") * (fs / n)).alias("freq_hz"), "psd"
    )


def compare_stages(raw: DataFrame, filtered: DataFrame, fs: int, block_len: int, channel: int = 1, seconds: float = 2) -> DataFrame:
    """Raw and filtered spectrum of each case side by side."""
    parts = [
        track_spectrum(b, fs, block_len, channel, seconds).withColumn("stage", F.lit(name))
        for name, b in (("raw", raw), ("filtered", filtered))
    ]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("case_id", "freq_hz").pivot("stage", ["raw", "filtered"]).agg(F.first("psd"))


def extract_features(
    epochs: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS, registry: Registry = FEATURES, overrides: dict | None = None
) -> DataFrame:
    """All named features of each epoch in one projection; band shares become columns."""
    flat = epochs.select(*keys, *registry.columns(names, overrides))
    out = [F.col(k) for k in keys]
    for f in flat.schema.fields[len(keys):]:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"{f.name}.{s}").alias(s) for s in f.dataType.names]
        else:
            out.append(F.col(f.name))
    return flat.select(*out)
