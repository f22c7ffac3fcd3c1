"""Episode mining, windows and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.catalog import inputs as I
from epochwise.operators import episodes as E
from epochwise.operators import epochs as P
from epochwise.operators import tracks as T
from epochwise.session import materialize

THRESHOLDS = [(20.0, 0.1), (20.0, 0.3), (35.0, 0.1)]
LENGTHS = [2, 3]
REFRACTORY = [5.0, 20.0]
WINDOWS = [5, 10]
OVERLAPS = [0.0, 0.25, 0.5]


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(T.interpolate_extrapolate(I.tracks(spark, sf))[0], "filled")


FILLED = I.TRACKS + """,
known AS (SELECT case_id, time AS t, mac AS v, row_number() OVER (PARTITION BY case_id ORDER BY row_idx) AS rn,
    count(*) OVER (PARTITION BY case_id) AS kn FROM tracks WHERE mac IS NOT NULL),
ends AS (SELECT case_id, max(kn) AS kn, max(t) FILTER (rn = 1) AS h1, max(v) FILTER (rn = 1) AS hv1,
    max(t) FILTER (rn = 2) AS h2, max(v) FILTER (rn = 2) AS hv2,
    max(t) FILTER (rn = kn - 1) AS e1, max(v) FILTER (rn = kn - 1) AS ev1,
    max(t) FILTER (rn = kn) AS e2, max(v) FILTER (rn = kn) AS ev2 FROM known GROUP BY case_id),
around AS (SELECT *,
    last_value(CASE WHEN mac IS NOT NULL THEN time END IGNORE NULLS) OVER w AS pt, last_value(mac IGNORE NULLS) OVER w AS pv,
    first_value(CASE WHEN mac IS NOT NULL THEN time END IGNORE NULLS) OVER x AS nt, first_value(mac IGNORE NULLS) OVER x AS nv
  FROM tracks WINDOW w AS (PARTITION BY case_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    x AS (PARTITION BY case_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT a.case_id, row_idx, time, bis, bis_sr, CASE WHEN mac IS NOT NULL THEN mac
    WHEN pt IS NULL THEN hv1 + (hv2 - hv1) * ((time - h1) / (h2 - h1))
    WHEN nt IS NULL THEN ev1 + (ev2 - ev1) * ((time - e1) / (e2 - e1))
    ELSE pv + (nv - pv) * ((time - pt) / (nt - pt)) END AS mac
  FROM around a JOIN ends e ON a.case_id = e.case_id WHERE e.kn >= 2)"""

_TH = ", ".join(f"({b}, {m})" for b, m in THRESHOLDS)
_LEN = ", ".join(f"({m})" for m in LENGTHS)
_REF = ", ".join(f"({r})" for r in REFRACTORY)
EPISODES = FILLED + f""",
th(bis_threshold, mac_threshold) AS (SELECT CAST(a AS DOUBLE), CAST(b AS DOUBLE) FROM (VALUES {_TH}) v(a, b)),
ln(min_episode_length) AS (VALUES {_LEN}),
rf(refractory_time) AS (SELECT CAST(a AS DOUBLE) FROM (VALUES {_REF}) v(a)),
st AS (SELECT bis_threshold, mac_threshold, case_id, row_idx, time, coalesce(bis > bis_threshold, false) AS up,
    coalesce(mac > mac_threshold, false) AS hi, count(*) OVER (PARTITION BY bis_threshold, mac_threshold, case_id) AS n
  FROM filled, th),
isl AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY bis_threshold, mac_threshold, case_id ORDER BY row_idx) AS g FROM st),
ahead AS ({" UNION ALL ".join(f'''SELECT *, {m} AS min_episode_length, bool_and(up AND hi) OVER w AND count(*) OVER w = {m} AS ok FROM isl
  WINDOW w AS (PARTITION BY bis_threshold, mac_threshold, case_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)''' for m in LENGTHS)}),
eps AS (SELECT bis_threshold, mac_threshold, min_episode_length, case_id, g,
    min(time) FILTER (ok AND row_idx < n - min_episode_length) AS start, max(time) AS "end", max(row_idx) AS last_row, max(n) AS n
  FROM ahead WHERE up GROUP BY ALL),
kept AS (SELECT bis_threshold, mac_threshold, min_episode_length, case_id, start, "end" FROM eps
  WHERE start IS NOT NULL AND last_row + 1 < n - min_episode_length),
flag0 AS (SELECT *, start - lag("end") OVER w AS before, lead(start) OVER w - "end" AS after FROM kept, rf
  WINDOW w AS (PARTITION BY bis_threshold, mac_threshold, min_episode_length, case_id, refractory_time ORDER BY start)),
episodes AS (SELECT bis_threshold, mac_threshold, min_episode_length, refractory_time, case_id, start, "end",
    coalesce(before < refractory_time, false) OR coalesce(after < refractory_time, false) AS flagged FROM flag0),
merge0 AS (SELECT *, CASE WHEN flagged AND lag(flagged) OVER w AND start - lag("end") OVER w < refractory_time THEN 0 ELSE 1 END AS brk
  FROM episodes WINDOW w AS (PARTITION BY bis_threshold, mac_threshold, min_episode_length, refractory_time, case_id ORDER BY start)),
merge1 AS (SELECT *, sum(brk) OVER (PARTITION BY bis_threshold, mac_threshold, min_episode_length, refractory_time, case_id ORDER BY start) AS grp FROM merge0),
merged AS (SELECT bis_threshold, mac_threshold, min_episode_length, refractory_time, case_id, min(start) AS start, max("end") AS "end"
  FROM merge1 GROUP BY bis_threshold, mac_threshold, min_episode_length, refractory_time, case_id, grp)"""


def _windows_sql(source: str) -> str:
    cuts = ", ".join(f"({w}, {o})" for w in WINDOWS for o in OVERLAPS)
    return f"""cuts(fixed_window, overlap_frac) AS (SELECT a, CAST(b AS DOUBLE) FROM (VALUES {cuts}) v(a, b)),
win0 AS (SELECT *, unnest(range(CAST(floor(("end" - start - fixed_window) / (fixed_window * (1 - overlap_frac))) AS INT) + 1)) AS i
  FROM {source}, cuts WHERE "end" - start >= fixed_window),
windows AS (SELECT bis_threshold, mac_threshold, min_episode_length, refractory_time, case_id, fixed_window, overlap_frac,
    ceil(start + i * (fixed_window * (1 - overlap_frac))) AS start,
    ceil(start + i * (fixed_window * (1 - overlap_frac)) + fixed_window) AS "end" FROM win0),
grid AS (SELECT * FROM th, ln, rf, cuts),
counts AS (SELECT g.*, count(w.case_id) AS num_episodes FROM grid g LEFT JOIN windows w ON g.bis_threshold = w.bis_threshold
  AND g.mac_threshold = w.mac_threshold AND g.min_episode_length = w.min_episode_length AND g.refractory_time = w.refractory_time
  AND g.fixed_window = w.fixed_window AND g.overlap_frac = w.overlap_frac GROUP BY ALL)"""


def episodes(spark, sf):
    return materialize(E.detect_episodes(_filled(spark, sf), THRESHOLDS, LENGTHS, REFRACTORY), "episodes")


def merged(spark, sf):
    return E.merge_flagged(episodes(spark, sf))


def windows(spark, sf, use_merged=False):
    return E.cut_windows(merged(spark, sf) if use_merged else episodes(spark, sf), WINDOWS, OVERLAPS)


def _grid(spark):
    rows = [(b, m, n, r, w, o) for b, m in THRESHOLDS for n in LENGTHS for r in REFRACTORY for w in WINDOWS for o in OVERLAPS]
    schema = ("bis_threshold double, mac_threshold double, min_episode_length int, refractory_time double, "
              "fixed_window int, overlap_frac double")
    return spark.createDataFrame(rows, schema)


def counts(spark, sf, use_merged=False):
    return E.count_windows(windows(spark, sf, use_merged), _grid(spark))


def count_difference(spark, sf):
    e = episodes(spark, sf)
    grid = _grid(spark)
    normal = E.count_windows(E.cut_windows(e, WINDOWS, OVERLAPS), grid)
    joined = E.count_windows(E.cut_windows(E.merge_flagged(e), WINDOWS, OVERLAPS), grid)
    return E.merged_count_difference(normal, joined, REFRACTORY)


def _r(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


_EP_COLS = """bis_threshold, mac_threshold, min_episode_length, refractory_time, case_id, round(start, 6) AS start, round("end", 6) AS "end\""""


def awake_epoch_input(spark, sf):
    return I.cohort(spark, sf).filter("anestart > 0").select(
        "case_id", F.lit(0.0).alias("start"), F.floor("anestart").cast("double").alias("end"))


AWAKE = I.COHORT + """, awake0 AS (SELECT case_id, CAST(floor((floor(anestart) - 10) / 500) AS INT) AS n FROM cohort WHERE anestart > 0),
awake AS (SELECT case_id, i * 500.0 AS start, i * 500.0 + 500 AS "end" FROM (SELECT case_id, unnest(range(n)) AS i FROM awake0 WHERE n > 0))"""


def anesthesia_cases(spark, sf):
    return I.cohort(spark, sf).select(
        "case_id", F.when(F.col("anestart") > 0, F.floor(F.col("anestart") / 100)).alias("anestart"),
        (F.pmod(F.col("case_id") * 37, F.lit(2000)) + 500).alias("duration"))


ANESTHESIA = I.COHORT + """, an0 AS (SELECT case_id, coalesce(CASE WHEN anestart > 0 THEN CAST(floor(anestart / 100) AS BIGINT) END, 600) + 10 AS lo,
    (case_id * 37) % 2000 + 500 - 600 - 20 AS hi FROM cohort),
an1 AS (SELECT *, least(floor((hi - lo) / 20), 30) AS take, md5('42:' || case_id) AS h FROM an0 WHERE hi > lo AND floor((hi - lo) / 20) > 0),
an2 AS (SELECT *, sum(take) OVER (ORDER BY h, case_id) AS cum FROM an1),
an3 AS (SELECT *, least(take, 700 - (cum - take)) AS quota FROM an2),
an4 AS (SELECT case_id, quota, unnest(range(lo, hi - 20 + 1)) AS start FROM an3 WHERE quota > 0),
an5 AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY md5('42:' || case_id || ':' || start), start) AS pick FROM an4),
anesthesia AS (SELECT case_id, CAST(start AS DOUBLE) AS start, CAST(start + 20 AS DOUBLE) AS "end" FROM an5 WHERE pick <= quota)"""


def interpolation(spark, sf):
    return _r(_filled(spark, sf).select("case_id", "row_idx", "mac"), "mac")


def hold_ends(spark, sf):
    t = I.tracks(spark, sf).withColumnRenamed("row_idx", "idx")
    return _r(T.interpolate_hold_ends(t, ["bis", "mac"]).select("case_id", "idx", "bis", "mac"), "bis", "mac")


HOLD = I.TRACKS + """, ar AS (SELECT *,
    last_value(CASE WHEN bis IS NOT NULL THEN row_idx END IGNORE NULLS) OVER w AS bp, last_value(bis IGNORE NULLS) OVER w AS bpv,
    first_value(CASE WHEN bis IS NOT NULL THEN row_idx END IGNORE NULLS) OVER x AS bn, first_value(bis IGNORE NULLS) OVER x AS bnv,
    last_value(CASE WHEN mac IS NOT NULL THEN row_idx END IGNORE NULLS) OVER w AS mp, last_value(mac IGNORE NULLS) OVER w AS mpv,
    first_value(CASE WHEN mac IS NOT NULL THEN row_idx END IGNORE NULLS) OVER x AS mn, first_value(mac IGNORE NULLS) OVER x AS mnv
  FROM tracks WINDOW w AS (PARTITION BY case_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    x AS (PARTITION BY case_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT case_id, row_idx AS idx,
  round(coalesce(bis, CASE WHEN bp IS NULL THEN bnv WHEN bn IS NULL THEN bpv ELSE bpv + (bnv - bpv) * ((row_idx - bp) / (bn - bp)) END), 6) AS bis,
  round(coalesce(mac, CASE WHEN mp IS NULL THEN mnv WHEN mn IS NULL THEN mpv ELSE mpv + (mnv - mpv) * ((row_idx - mp) / (mn - mp)) END), 6) AS mac
FROM ar"""


def merge_rows(spark, sf):
    t = I.tracks(spark, sf)
    other = t.filter("not (case_id % 10 = 3 and row_idx = 0)").select("case_id", "row_idx", F.col("bis_sr").alias("extra"))
    merged_rows, _ = T.merge_by_row(t.select("case_id", "row_idx", "bis"), other, ["extra"])
    return merged_rows


def unequal_rows(spark, sf):
    t = I.tracks(spark, sf)
    other = t.filter("not (case_id % 10 = 3 and row_idx = 0)").select("case_id", "row_idx", F.col("bis_sr").alias("extra"))
    return T.merge_by_row(t.select("case_id", "row_idx", "bis"), other, ["extra"])[1]


def trim(spark, sf):
    z = I.samples(spark, sf).withColumn("ch1", F.round("ch1", 1)).withColumn("ch2", F.when(F.col("idx") % 64 >= 5, F.round("ch2", 1)).otherwise(0.0))
    z = z.withColumn("ch1", F.when(F.col("idx") >= 7, F.col("ch1")).otherwise(0.0)).withColumn("ch2", F.when(F.col("idx") >= 7, F.col("ch2")).otherwise(0.0))
    t = T.trim_zero_rows(z, ["ch1", "ch2"])
    return t.withColumns({c: F.col(c) + F.lit(0.0) for c in ("ch1", "ch2")})  # minus zero as zero


TRIM = I.SAMPLES + """, z AS (SELECT case_id, idx, CASE WHEN idx >= 7 THEN round(ch1, 1) ELSE 0.0 END AS ch1,
   CASE WHEN idx >= 7 AND idx % 64 >= 5 THEN round(ch2, 1) ELSE 0.0 END AS ch2 FROM samples),
 b AS (SELECT case_id, min(idx) AS a, max(idx) AS b FROM z WHERE ch1 <> 0 OR ch2 <> 0 GROUP BY case_id)
SELECT z.case_id, idx - a AS idx, ch1 + 0.0 AS ch1, ch2 + 0.0 AS ch2 FROM z JOIN b ON z.case_id = b.case_id WHERE idx BETWEEN a AND b"""


def monitor_stats(spark, sf):
    w = windows(spark, sf).select("case_id", "start", "end").distinct()
    return _r(P.monitor_statistics(w, I.tracks(spark, sf), bucket=12.0), "bis_sr_mean")


MONITOR = f"""mon AS (SELECT w.case_id, w.start, w."end", avg(coalesce(bis_sr, 0)) AS m, min(coalesce(bis_sr, 0)) AS lo, max(coalesce(bis_sr, 0)) AS hi
  FROM (SELECT DISTINCT case_id, start, "end" FROM windows) w JOIN tracks t ON w.case_id = t.case_id AND t.time BETWEEN w.start AND w."end" GROUP BY ALL)"""


def sr_histogram(spark, sf):
    w = windows(spark, sf).select("case_id", "start", "end").distinct()
    m = P.monitor_statistics(w, I.tracks(spark, sf), bucket=12.0)
    return P.equal_width_histogram(m.withColumn("bis_sr_mean", F.round("bis_sr_mean", 6)), "bis_sr_mean", 30)


QUERIES = {
    "c1_awake_selection": (
        lambda s, d: T.awake_times(I.cohort(s, d), I.tracks(s, d)),
        f"WITH {I.TRACKS}, {I.COHORT} SELECT case_id, anestart FROM cohort WHERE anestart > 0 AND case_id IN (SELECT case_id FROM tracks)"),
    "c1_awake_total": (
        lambda s, d: _r(T.awake_total(T.awake_times(I.cohort(s, d), I.tracks(s, d))), "total_awake", n=2),
        f"WITH {I.TRACKS}, {I.COHORT} SELECT count(*) AS n_cases, round(sum(anestart), 2) AS total_awake FROM cohort WHERE anestart > 0 AND case_id IN (SELECT case_id FROM tracks)"),
    "c2_has_signal_cases": (
        lambda s, d: T.cases_with_signal(I.tracks(s, d).withColumn("mac", F.when(F.col("case_id") % 4 == 1, F.lit(0.0)).otherwise(F.col("mac")))).select("case_id", "row_idx", "mac"),
        f"WITH {I.TRACKS}, t AS (SELECT case_id, row_idx, CASE WHEN case_id % 4 = 1 THEN 0.0 ELSE mac END AS mac FROM tracks) "
        "SELECT * FROM t WHERE case_id IN (SELECT case_id FROM t WHERE mac <> 0)"),
    "c3_trim_zero_rows": (trim, "WITH " + TRIM),
    "c4_valid_times": (
        lambda s, d: _r(T.valid_times(I.tracks(s, d)), "first_valid_time", "last_valid_time"),
        f"WITH {I.TRACKS} SELECT case_id, round(min_by(time, row_idx), 6) AS first_valid_time, round(max_by(time, row_idx), 6) AS last_valid_time "
        "FROM tracks WHERE bis <> 0 GROUP BY case_id"),
    "d1_row_aligned_merge": (
        merge_rows,
        f"""WITH {I.TRACKS}, o AS (SELECT case_id, row_idx, bis_sr AS extra FROM tracks WHERE NOT (case_id % 10 = 3 AND row_idx = 0)),
        ok AS (SELECT case_id FROM (SELECT case_id, count(*) n FROM tracks GROUP BY 1) a JOIN (SELECT case_id, count(*) n FROM o GROUP BY 1) b USING (case_id, n))
        SELECT t.case_id, t.row_idx, t.bis, o.extra FROM tracks t JOIN o ON t.case_id = o.case_id AND t.row_idx = o.row_idx WHERE t.case_id IN (FROM ok)"""),
    "d1_unequal_lengths": (
        unequal_rows,
        f"""WITH {I.TRACKS}, a AS (SELECT case_id, count(*) n_base, count(*) FILTER (NOT (case_id % 10 = 3 AND row_idx = 0)) n_other FROM tracks GROUP BY 1)
        SELECT * FROM a WHERE n_base <> n_other"""),
    "f1_interpolate_extrapolate": (
        interpolation, f"WITH {FILLED} SELECT case_id, row_idx, round(mac, 6) AS mac FROM filled"),
    "f2_interpolate_hold_ends": (hold_ends, "WITH " + HOLD),
    "f3_step_fill": (
        lambda s, d: T.step_fill(I.tracks(s, d), "mac").select("case_id", "row_idx", "mac"),
        f"WITH {I.TRACKS} SELECT case_id, row_idx, last_value(mac IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY row_idx) AS mac FROM tracks"),
    "f4_f5_f8_episode_sweep": (
        lambda s, d: _r(episodes(s, d), "start", "end"), f"WITH {EPISODES} SELECT {_EP_COLS}, flagged FROM episodes"),
    "f6_merged_episodes": (
        lambda s, d: _r(merged(s, d), "start", "end"), f"WITH {EPISODES} SELECT {_EP_COLS} FROM merged"),
    "f7_valid_times_of_episode_cases": (
        lambda s, d: _r(E.summary_times(T.valid_times(I.tracks(s, d)), E.detect_episodes(_filled(s, d), THRESHOLDS[:1], [3], [5.0])), "first_valid_time", "last_valid_time"),
        f"""WITH {EPISODES} SELECT case_id, round(min_by(time, row_idx), 6) AS first_valid_time, round(max_by(time, row_idx), 6) AS last_valid_time
        FROM tracks WHERE bis <> 0 AND case_id IN (SELECT case_id FROM kept WHERE bis_threshold = 20 AND mac_threshold = 0.1 AND min_episode_length = 3) GROUP BY case_id"""),
    "i1_fixed_windows": (
        lambda s, d: windows(s, d), f"""WITH {EPISODES}, {_windows_sql("episodes")} SELECT * FROM windows"""),
    "e1_window_counts": (
        lambda s, d: counts(s, d), f"""WITH {EPISODES}, {_windows_sql("episodes")} SELECT * FROM counts"""),
    "e2_window_overlap_pivot": (
        lambda s, d: E.window_overlap_pivot(counts(s, d), OVERLAPS),
        f"""WITH {EPISODES}, {_windows_sql("episodes")} SELECT bis_threshold, mac_threshold, min_episode_length, refractory_time, fixed_window AS "window",
        max(num_episodes) FILTER (overlap_frac = 0) AS overlap_000, max(num_episodes) FILTER (overlap_frac = 0.25) AS overlap_025,
        max(num_episodes) FILTER (overlap_frac = 0.5) AS overlap_050 FROM counts GROUP BY ALL"""),
    "d9_merged_count_difference": (
        count_difference,
        f"""WITH {EPISODES}, {_windows_sql("episodes")}, {_windows_sql("merged").replace("cuts(fixed_window", "cutsm(fixed_window").replace(", cuts WHERE", ", cutsm WHERE").replace("rf, cuts)", "rf, cutsm)").replace("win0", "win0m").replace("windows AS", "windowsm AS").replace("JOIN windows", "JOIN windowsm").replace("grid AS", "gridm AS").replace("FROM grid", "FROM gridm").replace("counts AS", "countsm AS")}
        SELECT n.bis_threshold, n.mac_threshold, n.min_episode_length, n.fixed_window, n.overlap_frac,
          CAST(sum(n.num_episodes - m.num_episodes) FILTER (n.refractory_time = 5) AS BIGINT) AS ref_5,
          CAST(sum(n.num_episodes - m.num_episodes) FILTER (n.refractory_time = 20) AS BIGINT) AS ref_20
        FROM counts n JOIN countsm m USING (bis_threshold, mac_threshold, min_episode_length, refractory_time, fixed_window, overlap_frac) GROUP BY ALL"""),
    "e3_duration_histogram": (
        lambda s, d: _r(E.duration_histogram(episodes(s, d), ["bis_threshold", "mac_threshold"]).filter("n > 0"), "bin_width", "bin_start"),
        f"""WITH {EPISODES}, d AS (SELECT bis_threshold, mac_threshold, "end" - start AS du FROM episodes),
        q AS (SELECT bis_threshold, mac_threshold, min(du) AS lo, 2 * (quantile_cont(du, 0.75) - quantile_cont(du, 0.25)) * pow(count(*), -1.0 / 3) AS w FROM d GROUP BY ALL)
        SELECT bis_threshold, mac_threshold, CAST(floor((du - lo) / w) AS BIGINT) AS bin, round(w, 6) AS bin_width,
          round(lo + floor((du - lo) / w) * w, 6) AS bin_start, count(*) AS n FROM d JOIN q USING (bis_threshold, mac_threshold) GROUP BY ALL"""),
    "e3_duration_ecdf": (
        lambda s, d: _r(E.duration_ecdf(_r(episodes(s, d), "start", "end"), ["bis_threshold", "mac_threshold"]), "duration", "ecdf"),
        f"""WITH {EPISODES}, d AS (SELECT bis_threshold, mac_threshold, round("end", 6) - round(start, 6) AS du FROM episodes),
        c AS (SELECT DISTINCT bis_threshold, mac_threshold, du, cume_dist() OVER (PARTITION BY bis_threshold, mac_threshold ORDER BY du) AS e FROM d)
        SELECT bis_threshold, mac_threshold, round(du, 6) AS duration, round(e, 6) AS ecdf FROM c"""),
    "e21_d4_suppression_statistics": (
        monitor_stats,
        f"""WITH {EPISODES}, {_windows_sql("episodes")}, {MONITOR} SELECT case_id, start, "end", round(m, 6) AS bis_sr_mean, lo AS bis_sr_min, hi AS bis_sr_max FROM mon"""),
    "e21_suppression_histogram": (
        sr_histogram,
        f"""WITH {EPISODES}, {_windows_sql("episodes")}, {MONITOR}, r AS (SELECT round(m, 6) AS m FROM mon), s AS (SELECT min(m) AS lo, max(m) AS hi FROM r)
        SELECT CAST(least(floor((m - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM r, s GROUP BY 1"""),
    "e22_last_activity": (
        lambda s, d: _r(T.last_activity(I.tracks(s, d).withColumn("bis_sr", F.greatest(F.col("bis_sr") - 90, F.lit(0.0))), horizon=100), "seconds_before_end"),
        f"""WITH {I.TRACKS}, e AS (SELECT case_id, max(time) AS t, max(time) FILTER (greatest(bis_sr - 90, 0) > 0) AS a FROM tracks GROUP BY 1)
        SELECT case_id, round(CASE WHEN t - a <= 100 THEN t - a ELSE 100 END, 6) AS seconds_before_end FROM e"""),
    "i2_awake_epochs": (
        lambda s, d: P.awake_epochs(awake_epoch_input(s, d), 500, 10), f"""WITH {AWAKE} SELECT case_id, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end" FROM awake"""),
    "i3_anesthesia_epochs": (
        lambda s, d: P.sample_anesthesia_epochs(anesthesia_cases(s, d), 20, 700), f"""WITH {ANESTHESIA} SELECT * FROM anesthesia"""),
    "i4_epochs_by_case": (
        lambda s, d: P.group_by_case(P.awake_epochs(awake_epoch_input(s, d), 500, 10)),
        f"""WITH {AWAKE} SELECT case_id, count(*) AS n_epochs, CAST(min(start) AS DOUBLE) AS first_start, CAST(max("end") AS DOUBLE) AS last_end FROM awake GROUP BY 1"""),
    "c7_allowed_cases": (
        lambda s, d: P.allow_cases(P.awake_epochs(awake_epoch_input(s, d), 500, 10), I.tracks(s, d).select("case_id").distinct()),
        f"""WITH {I.TRACKS}, {AWAKE} SELECT case_id, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end" FROM awake WHERE case_id IN (SELECT case_id FROM tracks)"""),
    "d10_initial_distribution": (
        lambda s, d: P.initial_distribution(windows(s, d), P.awake_epochs(awake_epoch_input(s, d), 500, 10)),
        f"""WITH {EPISODES}, {_windows_sql("episodes")}, {AWAKE}, u AS (SELECT case_id, 1 AS f FROM windows UNION ALL SELECT case_id, 0 FROM awake)
        SELECT case_id, count(*) FILTER (f = 1) AS faw_epochs, count(*) FILTER (f = 0) AS awake_epochs FROM u GROUP BY 1"""),
    "i6_balanced_anesthesia_epochs": (
        lambda s, d: P.sample_anesthesia_epochs(anesthesia_cases(s, d), 20, P.balancing_count(
            T.awake_times(I.cohort(s, d), I.tracks(s, d)), E.detect_episodes(_filled(s, d), THRESHOLDS[:1], [3], [5.0]))),
        f"""WITH {EPISODES}, {ANESTHESIA.replace("700", '''(SELECT greatest((SELECT count(*) FROM cohort WHERE anestart > 0 AND case_id IN (SELECT case_id FROM tracks)),
        (SELECT count(*) FROM kept WHERE bis_threshold = 20 AND mac_threshold = 0.1 AND min_episode_length = 3)))''')} SELECT * FROM anesthesia"""),
}
