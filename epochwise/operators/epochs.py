"""Epochs: fixed time windows of a case, and their match with tracks and waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators.ordered import hash_order, join_small, scan, stable_hash

KEYS = ["case_id", "start", "end"]


def awake_epochs(intervals: DataFrame, length: int, transition: float = 10) -> DataFrame:
    """Consecutive windows of each awake interval ``case_id, start, end``.

    ``transition`` seconds before the end are left out; cleaned intervals take 0.
    """
    n = F.floor((F.col("end") - F.col("start") - F.lit(float(transition))) / length).cast("int")
    cut = intervals.withColumn("_n", n).filter("_n > 0")
    cut = cut.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("start") + F.col("_i") * length
    return cut.select("case_id", start.alias("start"), (start + length).alias("end"))


def sample_anesthesia_epochs(
    cases: DataFrame, length: int, n: int, transition: int = 10, margin_min: int = 10, seed: int = 42, per_case: int = 30
) -> DataFrame:
    """Random windows from the anesthesia part of each case, ``n`` in all.

    ``cases`` holds ``case_id, duration`` (seconds) and ``anestart`` (null: the margin is used).
    Cases are visited in seeded random order and each gives at most ``per_case`` windows.
    """
    lo = F.coalesce(F.col("anestart").cast("long"), F.lit(margin_min * 60)) + transition
    hi = F.col("duration").cast("long") - margin_min * 60 - length
    room = (
        cases.select("case_id", lo.alias("_lo"), hi.alias("_hi"))
        .withColumn("_max", F.floor((F.col("_hi") - F.col("_lo")) / length))
        .filter("_hi > _lo and _max > 0")
        .withColumn("_take", F.least(F.col("_max"), F.lit(per_case)))
        .withColumn("_h", stable_hash(seed, "case_id"))
        .withColumn("_hc", F.substring("_h", 1, 3))
    )
    queue = scan(room, [], "_hc", ["_h", "case_id"], sums={"_cum": F.col("_take")})
    quota = F.least(F.col("_take"), F.lit(n) - (F.col("_cum") - F.col("_take")))
    chosen = queue.withColumn("_quota", quota).filter("_quota > 0")
    starts = chosen.select(
        "case_id", "_quota", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - length)).alias("start")
    )
    picked = hash_order(starts, ["case_id"], seed, ["case_id", "start"], "_pick", digits=1).filter("_pick <= _quota")
    return picked.select("case_id", F.col("start").cast("double").alias("start"), (F.col("start") + length).cast("double").alias("end"))


def group_by_case(epochs: DataFrame) -> DataFrame:
    """I4: number of epochs per case with first start and last end.

    Kept as a report: operators below join on the epoch key and never need a case's epochs in one list.
    """
    return epochs.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.min("start").alias("first_start"), F.max("end").alias("last_end")
    )


def epochs_of_type(sources: dict[str, DataFrame], epoch_type: str) -> DataFrame:
    """I4: epochs of one class; an unknown class is an error."""
    if epoch_type not in sources:
        raise ValueError(f'{epoch_type!r} not recognized, only {sorted(sources)}')
    return sources[epoch_type]


def balancing_count(awake: DataFrame, faw: DataFrame) -> int:
    """Number of anesthesia epochs that balances the larger of the two other classes."""
    n = max(awake.count(), faw.count())
    if n == 0:
        raise ValueError("both epoch tables are empty")
    return n


def allow_cases(epochs: DataFrame, allowed: DataFrame, case: str = "case_id") -> DataFrame:
    """Epochs of listed cases only."""
    return epochs.join(allowed.select(case), case, "left_semi")


def monitor_statistics(epochs: DataFrame, tracks: DataFrame, value: str = "bis_sr", bucket: float = 60.0) -> DataFrame:
    """Mean, min and max of the track rows with ``start <= time <= end``; missing counts as 0.

    Each epoch is listed under the time buckets it touches, which turns the range condition into
    an equality on ``(case, bucket)`` with a cheap residual filter. Epochs without rows disappear.
    """
    e = epochs.select(*KEYS).distinct().withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))
    )
    t = tracks.select("case_id", "time", F.coalesce(value, F.lit(0.0)).alias("_v")).withColumn(
        "_b", F.floor(F.col("time") / bucket)
    )
    hit = e.join(t, ["case_id", "_b"]).filter(F.col("time").between(F.col("start"), F.col("end")))
    return hit.groupBy(*KEYS).agg(
        F.avg("_v").alias(f"{value}_mean"), F.min("_v").alias(f"{value}_min"), F.max("_v").alias(f"{value}_max")
    )


def equal_width_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Histogram over the value range, last bin closed."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(bins - 1))
    return (
        join_small(df, span, []).withColumn("bin", F.coalesce(number, F.lit(0)))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )


def epoch_samples(
    epochs: DataFrame, blocks: DataFrame, fs: int, block_len: int, channel: int = 1, complete: bool = False
) -> DataFrame:
    """D3: the samples ``[int(start*fs), int(end*fs))`` of one channel for each epoch.

    ``blocks`` is a waveform table (``case_id, block, fs, ch1, ch2``) of one sampling rate. An epoch is listed
    under the blocks it touches and takes a slice of each, so the join is an equality on
    ``(case_id, block)`` and an epoch only meets the few blocks it overlaps. Epochs beyond the end of
    the track come out short; ``complete=True`` drops them (C8).
    """
    if channel not in (1, 2):
        raise ValueError(f"there are channels 1 and 2, not {channel}")
    keys, size = epochs.columns, block_len
    e = (
        epochs.withColumn("_a", (F.col("start") * fs).cast("long"))
        .withColumn("_z", (F.col("end") * fs).cast("long"))
        .filter("_z > _a")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_z") - 1) / size))))
    )
    b = blocks.select("case_id", "block", F.col(f"ch{channel}").alias("_x"))
    lo = F.greatest(F.col("_a") - F.col("block") * size, F.lit(0))
    hi = F.least(F.col("_z") - F.col("block") * size, F.size("_x").cast("long"))
    part = F.slice("_x", (lo + 1).cast("int"), (hi - lo).cast("int"))
    pieces = e.join(b, ["case_id", "block"]).filter(hi > lo).select(*keys, "_a", "_z", F.struct("block", part.alias("x")).alias("_s"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s.x))
    out = pieces.groupBy(*keys, "_a", "_z").agg(joined.alias("eeg")).withColumn("fs", F.lit(fs))
    if complete:
        out = out.filter(F.size("eeg") == F.col("_z") - F.col("_a"))
    return out.drop("_a", "_z")


def complete_segments(segments: DataFrame, samples: int, column: str = "eeg") -> DataFrame:
    """Segments with exactly the expected number of samples."""
    return segments.filter(F.size(column) == samples)


def sliding_segments(anestart: DataFrame, lengths: DataFrame, fs: int, samples: int = 896, overlap: float = 0.75) -> DataFrame:
    """I5, label 1: windows in sample units from 0 to ``min(anestart*fs, track length)``."""
    step = int(samples * (1 - overlap))
    room = F.least((F.col("anestart") * fs).cast("long"), F.col("n_samples")) - samples
    cut = anestart.join(lengths, "case_id").withColumn("_room", room).filter("_room >= 0")
    at = cut.withColumn("segment_start", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_room") / step) * step, F.lit(step).cast("long"))))
    return at.select("case_id", "segment_start", (F.col("segment_start") + samples).alias("segment_end"), F.lit(1).alias("label"))


def fixed_segments(starts: DataFrame, lengths: DataFrame, fs: int, samples: int = 896) -> DataFrame:
    """I5, label 0: one segment from each given start, dropped when it passes the end of the track."""
    at = starts.withColumn("segment_start", (F.col("start") * fs).cast("long")).join(lengths, "case_id")
    return at.filter(F.col("segment_start") + samples <= F.col("n_samples")).select(
        "case_id", "segment_start", (F.col("segment_start") + samples).alias("segment_end"), F.lit(0).alias("label")
    )


def initial_distribution(faw: DataFrame, awake: DataFrame) -> DataFrame:
    """Epochs of both classes per case, 0 when a class is absent."""
    tagged = faw.select("case_id", F.lit("faw_epochs").alias("kind")).unionByName(
        awake.select("case_id", F.lit("awake_epochs").alias("kind"))
    )
    return tagged.groupBy("case_id").agg(
        F.count_if(F.col("kind") == "faw_epochs").alias("faw_epochs"),
        F.count_if(F.col("kind") == "awake_epochs").alias("awake_epochs"),
    )
