"""Episode mining: threshold runs, refractory flags, merging, and counts over parameter sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators.ordered import cumulative, join_small, percentiles, scan
from epochwise.session import materialize

PARAM_COLS = ["bis_threshold", "mac_threshold", "min_episode_length", "refractory_time"]


def threshold_runs(tracks: DataFrame, thresholds: Sequence[tuple[float, float]], chunk: str = "chunk") -> DataFrame:
    """Runs of rows above both thresholds, inside runs of rows above the BIS threshold.

    One row per stretch with BIS above and MAC continuously above (``n_good > 0``), or with BIS
    above only. Everything that depends on minimum length or refractory time works on these few
    rows, so a sweep reads the track once per distinct threshold pair.
    """
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("bis_threshold"), F.lit(float(m)).alias("mac_threshold"))
                      for b, m in thresholds])
    t = tracks.select("*", F.explode(pairs).alias("_p")).select("*", "_p.*").drop("_p")
    above = F.coalesce((F.col("bis") > F.col("bis_threshold")) & ~F.isnan("bis"), F.lit(False))
    good = above & F.coalesce((F.col("mac") > F.col("mac_threshold")) & ~F.isnan("mac"), F.lit(False))
    flagged = t.withColumn("_above", above).withColumn("_good", good)
    by = ["bis_threshold", "mac_threshold", "case_id"]
    numbered = scan(
        flagged, by, chunk, ["row_idx"],
        sums={"island": (~F.col("_above")).cast("long"), "stretch": (~F.col("_good")).cast("long")},
        totals={"n_rows": F.lit(1)},
    )
    # Time grows with the row number, so both can be taken apart: plain buffers, hash aggregate.
    return (
        numbered.filter("_above")
        .groupBy(*by, "island", "stretch")
        .agg(
            F.count_if("_good").alias("n_good"),
            F.min(F.when(F.col("_good"), F.col("row_idx"))).alias("first_row"),
            F.min(F.when(F.col("_good"), F.col("time"))).alias("first_time"),
            F.max("row_idx").alias("last_row"), F.max("time").alias("last_time"), F.max("n_rows").alias("n_rows"),
        )
    )


def episodes_from_runs(runs: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """F4 on runs: per BIS run the first stretch that is long enough opens an episode.

    With 0-based rows the scan covers rows below ``n_rows - m``: the opening row and the first row
    after the run must both lie there, so an episode still open at the end of the scan is dropped.
    """
    r = runs.withColumn("min_episode_length", F.explode(F.array(*[F.lit(int(m)) for m in lengths])))
    limit = F.col("n_rows") - F.col("min_episode_length")
    opens = (F.col("n_good") >= F.col("min_episode_length")) & (F.col("first_row") < limit)
    keys = ["bis_threshold", "mac_threshold", "min_episode_length", "case_id"]
    return (
        r.groupBy(*keys, "island")
        .agg(
            F.min(F.when(opens, F.col("first_time"))).alias("start"), F.max("last_time").alias("end"),
            F.max("last_row").alias("last_row"), F.max("n_rows").alias("n_rows"),
        )
        .filter(F.col("start").isNotNull() & (F.col("last_row") + 1 < limit))
        .select(*keys, "start", "end")
    )


def flag_refractory(
    episodes: DataFrame, refractory: Sequence[float], by: Sequence[str] | None = None, chunk_seconds: float = 3600
) -> DataFrame:
    """flag both neighbours when the pause between them is shorter than the refractory time."""
    by = list(by or ["bis_threshold", "mac_threshold", "min_episode_length", "case_id"])
    e = episodes.withColumn("refractory_time", F.explode(F.array(*[F.lit(float(x)) for x in refractory])))
    e = e.withColumn("_c", F.floor(F.col("start") / F.lit(float(chunk_seconds))))
    s = scan(e, [*by, "refractory_time"], "_c", ["start"],
             lag={"_prev_end": F.col("end")}, lead={"_next_start": F.col("start")})
    near_prev = F.coalesce(F.col("start") - F.col("_prev_end") < F.col("refractory_time"), F.lit(False))
    near_next = F.coalesce(F.col("_next_start") - F.col("end") < F.col("refractory_time"), F.lit(False))
    return s.withColumn("flagged", near_prev | near_next).drop("_c", "_prev_end", "_next_start")


def detect_episodes(
    tracks: DataFrame, thresholds: Sequence[tuple[float, float]], lengths: Sequence[int], refractory: Sequence[float],
    chunk: str = "chunk",
) -> DataFrame:
    """F4, F5 and the sweep F8: all parameter combinations from one set of runs.

    The few unflagged episodes are stored, so that flagging does not run the detection again.
    """
    found = materialize(episodes_from_runs(threshold_runs(tracks, thresholds, chunk), lengths), "found")
    return flag_refractory(found, refractory).select(*PARAM_COLS, "case_id", "start", "end", "flagged")


def merge_flagged(episodes: DataFrame, by: Sequence[str] | None = None, chunk_seconds: float = 3600) -> DataFrame:
    """join consecutive flagged episodes of a case whose pause is below the refractory time."""
    by = list(by or [*PARAM_COLS, "case_id"])
    e = episodes.withColumn("_c", F.floor(F.col("start") / F.lit(float(chunk_seconds))))
    s = scan(e, by, "_c", ["start"], lag={"_prev_end": F.col("end"), "_prev_flag": F.col("flagged")})
    joins = F.col("flagged") & F.col("_prev_flag") & (F.col("start") - F.col("_prev_end") < F.col("refractory_time"))
    s = s.withColumn("_break", (~F.coalesce(joins, F.lit(False))).cast("long"))
    s = scan(s, by, "_c", ["start"], sums={"_grp": F.col("_break")})
    return (
        s.groupBy(*by, "_grp")
        .agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"))
        .drop("_grp")
    )


def summary_times(valid: DataFrame, episodes: DataFrame) -> DataFrame:
    """first and last valid time of the cases that have episodes."""
    return valid.join(episodes.select("case_id").distinct(), "case_id", "left_semi")


def cut_windows(episodes: DataFrame, windows: Sequence[int], overlaps: Sequence[float]) -> DataFrame:
    """Fixed windows inside each episode, bounds rounded up to whole seconds."""
    if min(windows) < 1:
        raise ValueError(f"illegal window length: {min(windows)}")
    if not all(0 <= o < 1 for o in overlaps):
        raise ValueError("overlap must be at least 0 and below 1")
    cuts = F.array(*[F.struct(F.lit(int(w)).alias("fixed_window"), F.lit(float(o)).alias("overlap_frac"))
                     for w in windows for o in overlaps])
    step = F.col("fixed_window") * (1 - F.col("overlap_frac"))
    room = F.col("end") - F.col("start") - F.col("fixed_window")
    cut = (
        episodes.withColumn("_cut", F.explode(cuts)).select("*", "_cut.*").drop("_cut")
        .filter(room >= 0)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor(room / step).cast("int"))))
    )
    t = F.col("start") + F.col("_i") * step
    return cut.select(
        *[c for c in cut.columns if c not in ("start", "end", "_i", "flagged")],
        F.ceil(t).cast("double").alias("start"), F.ceil(t + F.col("fixed_window")).cast("double").alias("end"),
    )


def count_windows(windows: DataFrame, grid: DataFrame, merged: bool = False) -> DataFrame:
    """Windows per parameter set; sets without any window count 0.

    ``grid`` lists the parameter sets, which are few.
    """
    keys = [*PARAM_COLS, "fixed_window", "overlap_frac"]
    counts = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_episodes"))
    out = grid.join(counts, keys, "left").na.fill(0, ["num_episodes"])
    return out.withColumn("merged", F.lit(merged)) if merged else out


def window_overlap_pivot(counts: DataFrame, overlaps: Sequence[float]) -> DataFrame:
    """Per parameter set a table window by overlap; combinations not counted stay null."""
    named = counts.withColumn("_o", F.format_string("overlap_%03d", F.round(F.col("overlap_frac") * 100).cast("int")))
    names = [f"overlap_{round(o * 100):03d}" for o in overlaps]
    return (
        named.groupBy(*PARAM_COLS, F.col("fixed_window").alias("window"))
        .pivot("_o", names).agg(F.first("num_episodes"))
    )


def merged_count_difference(normal: DataFrame, merged: DataFrame, refractory: Sequence[float]) -> DataFrame:
    """Normal minus merged counts, one column per refractory time, absent counts as 0."""
    keys = ["bis_threshold", "mac_threshold", "min_episode_length", "fixed_window", "overlap_frac"]
    a = normal.select(*keys, "refractory_time", F.col("num_episodes").alias("n"))
    b = merged.select(*keys, "refractory_time", (-F.col("num_episodes")).alias("n"))
    # Adding signed rows equals a full outer join followed by a difference with 0 for absent rows.
    diff = a.unionByName(b).withColumn("_r", F.concat(F.lit("ref_"), F.col("refractory_time").cast("long")))
    return diff.groupBy(*keys).pivot("_r", [f"ref_{int(r)}" for r in refractory]).agg(F.sum("n")).na.fill(0)


def duration_histogram(episodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Freedman-Diaconis histogram of the durations."""
    by = list(by)
    d = episodes.withColumn("duration", F.col("end") - F.col("start"))
    q = percentiles(d, by, "duration", {"q1": 0.25, "q3": 0.75})
    span = d.groupBy(*by).agg(F.min("duration").alias("lo"), F.count(F.lit(1)).alias("n"))
    stats = join_small(q, span, by)
    width = 2 * (F.col("q3") - F.col("q1")) * F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    stats = stats.select(*by, "lo", F.when(width > 0, width).otherwise(F.lit(1.0)).alias("bin_width"))
    # Counting equal durations first leaves one row per distinct value for the join.
    grouped = d.groupBy(*by, "duration").agg(F.count(F.lit(1)).alias("n"))
    binned = join_small(grouped, stats, by).withColumn(
        "bin", F.floor((F.col("duration") - F.col("lo")) / F.col("bin_width"))
    )
    return binned.groupBy(*by, "bin", "bin_width", (F.col("lo") + F.col("bin") * F.col("bin_width")).alias("bin_start")).agg(
        F.sum("n").alias("n")
    )


def duration_ecdf(episodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of episodes not longer than each occurring duration."""
    d = episodes.withColumn("duration", F.col("end") - F.col("start"))
    c = cumulative(d, list(by), "duration", {"n": F.count(F.lit(1))})
    return c.select(*by, "duration", ((F.col("n_below") + F.col("n")) / F.col("n_total")).alias("ecdf"))
