"""Monitor tracks: one row per case and second, columns ``case_id, row_idx, time, bis, bis_sr, mac``.

``chunk`` is a time bucket of the track (see :func:`with_time_chunk`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochwise.operators.ordered import scan

HOUR = 3600


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Missing values are null from here on: Spark orders NaN above every number."""
    for c in columns:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df


def with_time_chunk(df: DataFrame, seconds: float = HOUR, time: str = "time", name: str = "chunk") -> DataFrame:
    return df.withColumn(name, F.floor(F.col(time) / F.lit(float(seconds))))


def number_rows(df: DataFrame, order: list[str], case: str = "case_id", chunk: str = "chunk") -> DataFrame:
    """Dense 0-based ``row_idx`` per case."""
    return scan(df, [case], chunk, order, sums={"_n": F.lit(1)}).withColumn("row_idx", F.col("_n") - 1).drop("_n")


def awake_times(cases: DataFrame, tracks: DataFrame) -> DataFrame:
    """Cases that have a track and a positive anesthesia start."""
    present = tracks.select("case_id").distinct()
    return cases.join(present, "case_id", "left_semi").filter(F.col("anestart") > 0).select("case_id", "anestart")


def awake_total(selected: DataFrame) -> DataFrame:
    """Number of contributing cases and sum of their awake times."""
    return selected.agg(F.count(F.lit(1)).alias("n_cases"), F.sum("anestart").alias("total_awake"))


def cases_with_signal(tracks: DataFrame, signal: str = "mac") -> DataFrame:
    """Rows of cases in which the signal is somewhere present and non-zero."""
    has = F.bool_or(F.coalesce((F.col(signal) != 0) & ~F.isnan(signal), F.lit(False)))
    keep = tracks.groupBy("case_id").agg(has.alias("has")).filter("has").select("case_id")
    return tracks.join(keep, "case_id", "left_semi")


def trim_zero_rows(samples: DataFrame, channels: list[str], case: str = "case_id", idx: str = "idx") -> DataFrame:
    """Drop leading and trailing rows in which every channel is zero, and re-index from 0."""
    nonzero = F.lit(False)
    for c in channels:
        nonzero = nonzero | (F.col(c) != 0)
    at = F.when(nonzero, F.col(idx))
    bounds = samples.groupBy(case).agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    return (
        samples.join(bounds, case)
        .filter(F.col(idx).between(F.col("_a"), F.col("_b")))
        .withColumn(idx, F.col(idx) - F.col("_a"))
        .drop("_a", "_b")
    )


def trim_zero_blocks(blocks: DataFrame, block_len: int) -> DataFrame:
    """C3 on waveform blocks: samples from the first to the last in which a channel is not zero, numbered and blocked anew.

    A block is cut where the new blocks begin, into two pieces at most; pieces, not samples, are exchanged.
    """
    channels = ["ch1", "ch2"]
    nonzero = F.transform(F.arrays_zip(*channels), lambda s: (s.ch1 != 0) | (s.ch2 != 0))
    size = F.size("ch1").cast("long")
    first, last = F.array_position(nonzero, True), F.array_position(F.reverse(nonzero), True)
    base = F.col("block").cast("long") * block_len
    ends = blocks.select("case_id", F.when(first > 0, base + first - 1).alias("a"), F.when(last > 0, base + size - last).alias("b"))
    bounds = ends.groupBy("case_id").agg(F.min("a").alias("_a"), F.max("b").alias("_b")).filter("_a IS NOT NULL")
    lo, hi = F.greatest(base, F.col("_a")), F.least(base + size - 1, F.col("_b"))
    kept = blocks.join(bounds, "case_id").withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi")
    new = lambda i: F.floor((i - F.col("_a")) / block_len)
    pieces = kept.withColumn("_new", F.explode(F.sequence(new(F.col("_lo")), new(F.col("_hi")))))
    start = F.greatest(F.col("_lo"), F.col("_a") + F.col("_new") * block_len)
    stop = F.least(F.col("_hi"), F.col("_a") + (F.col("_new") + 1) * block_len - 1)
    cut = [F.slice(c, (start - base + 1).cast("int"), (stop - start + 1).cast("int")).alias(c) for c in channels]
    parts = pieces.select("case_id", "fs", "_new", F.struct(start.alias("at"), *cut).alias("_p"))
    joined = parts.groupBy("case_id", "fs", "_new").agg(F.array_sort(F.collect_list("_p")).alias("_s"))
    return joined.select("case_id", F.col("_new").alias("block"), "fs", F.flatten(F.transform("_s", lambda p: p.ch1)).alias("ch1"), F.flatten(F.transform("_s", lambda p: p.ch2)).alias("ch2"))


def valid_times(tracks: DataFrame) -> DataFrame:
    """C4: time of the first and last row whose BIS is present and not zero."""
    at = F.when((F.col("bis") != 0) & ~F.isnan("bis"), F.col("row_idx"))
    return (
        tracks.groupBy("case_id")
        .agg(F.min_by("time", at).alias("first_valid_time"), F.max_by("time", at).alias("last_valid_time"))
        .filter("first_valid_time is not null")
    )


def merge_by_row(base: DataFrame, other: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Columns of another table of the same case appended row by row.

    Returns ``(merged, unequal)``; cases whose tables differ in length go to ``unequal`` and are
    left out of ``merged``.
    """
    a = base.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_base"))
    b = other.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_other"))
    lengths = a.join(b, "case_id", "full_outer").na.fill(0, ["n_base", "n_other"])
    unequal = lengths.filter("n_base <> n_other")
    good = lengths.filter("n_base = n_other").select("case_id")
    merged = base.join(other.select("case_id", "row_idx", *columns), ["case_id", "row_idx"])
    return merged.join(good, "case_id", "left_semi"), unequal


def _line(t: Column, a: str, b: str) -> Column:
    """Value at ``t`` of the line through two points given as column pairs ``<name>_t, <name>_v``."""
    at, av, bt, bv = (F.col(c) for c in (f"{a}_t", f"{a}_v", f"{b}_t", f"{b}_v"))
    return av + (bv - av) * F.try_divide(t - at, bt - at)


def interpolate_extrapolate(
    tracks: DataFrame, value: str = "mac", time: str = "time", case: str = "case_id",
    chunk: str = "chunk", order: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """fill gaps linearly on the time axis; outside the known range follow the nearest two points.

    Returns ``(filled, failed)``: cases with fewer than two known points are reported in ``failed``
    with their number of known points and do not appear in ``filled``.
    """
    order = order or ["row_idx"]
    has = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    kt = F.when(has, F.col(time))
    known = tracks.filter(has).select(case, *order, F.col(time).alias("_t"), F.col(value).cast("double").alias("_v"))

    def nearest_two(name: str, *direction: Column) -> DataFrame:
        # Spark keeps two rows per case in each task before the exchange (window group limit).
        ranked = known.withColumn("_rn", F.row_number().over(W.partitionBy(case).orderBy(*direction))).filter("_rn <= 2")
        return ranked.groupBy(case).agg(
            F.min("_t").alias(f"{name}a_t"), F.min_by("_v", "_t").alias(f"{name}a_v"),
            F.max("_t").alias(f"{name}b_t"), F.max_by("_v", "_t").alias(f"{name}b_v"), F.count(F.lit(1)).alias(f"{name}n"),
        )

    head = nearest_two("_h", *[F.col(c).asc() for c in order])
    tail = nearest_two("_e", *[F.col(c).desc() for c in order])
    near = scan(
        tracks, [case], chunk, order, ffill={"_p_t": kt, "_p_v": F.when(has, F.col(value))}, bfill={"_n_t": kt, "_n_v": F.when(has, F.col(value))},
        attach=head.join(tail, case),
    )
    t = F.col(time)
    filled = (
        F.when(has, F.col(value))
        .when(F.col("_p_t").isNull(), _line(t, "_ha", "_hb"))
        .when(F.col("_n_t").isNull(), _line(t, "_ea", "_eb"))
        .otherwise(_line(t, "_p", "_n"))
    )
    done = near.filter("_hn = 2").withColumn(value, filled)
    failed = tracks.groupBy(case).agg(F.count(value).alias("n_known")).filter("n_known < 2")
    return done.select(*tracks.columns), failed


def interpolate_hold_ends(
    samples: DataFrame, values: list[str], case: str = "case_id", idx: str = "idx", chunk: str = "chunk"
) -> DataFrame:
    """fill gaps linearly by row index; leading and trailing gaps take the nearest known value."""

    def known_at(v: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.col(idx).cast("double"))

    out = scan(
        samples, [case], chunk, [idx],
        ffill={**{f"_p{v}_t": known_at(v) for v in values}, **{f"_p{v}_v": F.col(v) for v in values}},
        bfill={**{f"_n{v}_t": known_at(v) for v in values}, **{f"_n{v}_v": F.col(v) for v in values}},
    )

    def filled(v: str) -> Column:
        inner = _line(F.col(idx), f"_p{v}", f"_n{v}")
        return F.coalesce(F.col(v), inner, F.col(f"_p{v}_v"), F.col(f"_n{v}_v")).alias(v)

    return out.select(*[filled(c) if c in values else F.col(c) for c in samples.columns])


def step_fill(samples: DataFrame, value: str, case: str = "case_id", idx: str = "row_idx", chunk: str = "chunk") -> DataFrame:
    """forward fill."""
    out = scan(samples, [case], chunk, [idx], ffill={"_f": F.col(value)})
    return out.withColumn(value, F.col("_f")).drop("_f")


def last_activity(tracks: DataFrame, value: str = "bis_sr", horizon: float = 600) -> DataFrame:
    """Seconds from the last positive value within the horizon to the end of the track."""
    last = tracks.groupBy("case_id").agg(
        F.max("time").alias("end_time"), F.max(F.when(F.col(value) > 0, F.col("time"))).alias("active")
    )
    gap = F.col("end_time") - F.col("active")
    return last.select(
        "case_id", F.when(gap <= horizon, gap).otherwise(F.lit(float(horizon))).alias("seconds_before_end")
    )
