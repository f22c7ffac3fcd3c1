"""Statistics over sets of epochs and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.catalog import inputs as I
from epochwise.catalog.relations import CASES, SPECTRA, rich_suppliers, spectra_rows
from epochwise.operators import stats as S

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(df, *cols, n=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def three_sets(s, d):
    """faw, wrong_awake and correct_awake by the id of the vector."""
    sp = spectra_rows(s, d)
    name = F.when(F.col("set") == "faw", "faw").when(F.col("start") % 3 == 0, "wrong_awake").otherwise("correct_awake")
    return sp.withColumn("set", name)


NAMES = ["faw", "wrong_awake", "correct_awake"]
THREE = SPECTRA + """, three AS (SELECT case_id, start, "end", CASE WHEN set = 'faw' THEN 'faw' WHEN start % 3 = 0 THEN 'wrong_awake' ELSE 'correct_awake' END AS set,
  freq_hz, psd FROM spec)"""
PAIRS = THREE + """, pairs(pair, a, b) AS (VALUES ('faw_vs_wrong_awake', 'faw', 'wrong_awake'), ('faw_vs_correct_awake', 'faw', 'correct_awake'),
  ('wrong_awake_vs_correct_awake', 'wrong_awake', 'correct_awake')),
tagged AS (SELECT pair, case_id, start, "end", freq_hz, psd, CASE WHEN set = a THEN 1 ELSE 0 END AS label FROM three, pairs WHERE set = a OR set = b),
eps AS (SELECT DISTINCT pair, label, case_id, start, "end" FROM tagged),
sz AS (SELECT pair, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS k FROM eps GROUP BY pair),
pk AS (SELECT e.*, row_number() OVER (PARTITION BY e.pair, label ORDER BY md5('42:' || case_id || ':' || start || ':' || "end"), case_id, start) AS rn, k FROM eps e JOIN sz USING (pair)),
eq AS (SELECT t.* FROM tagged t JOIN pk USING (pair, label, case_id, start, "end") WHERE rn <= k),
rk AS (SELECT *, rank() OVER (PARTITION BY pair, freq_hz ORDER BY psd) + (count(*) OVER (PARTITION BY pair, freq_hz, psd) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY pair, freq_hz, psd) AS t FROM eq),
ws AS (SELECT pair, freq_hz, count(*) FILTER (label = 1)::DOUBLE AS n1, count(*) FILTER (label = 0)::DOUBLE AS n0, sum(r) FILTER (label = 1) AS w, sum(t * t - 1)::DOUBLE AS ties FROM rk GROUP BY ALL)"""


def equal_pairs(s, d):
    tagged = S.set_pairs(three_sets(s, d), NAMES)
    equal = S.equal_sized_sets(tagged, ["pair"], ["case_id", "start", "end"])
    return tagged.join(equal, ["pair", "label", "case_id", "start", "end"], "left_semi")


def metadata(s, d):
    c = I.cohort(s, d)
    return c.withColumn("male", (F.col("c_nationkey") % 2).cast("double")).withColumn("seg", F.length("c_mktsegment").cast("double"))


META = I.COHORT + """, meta AS (SELECT *, c_nationkey % 2 AS male, length(c_mktsegment) AS seg FROM cohort),
pooled AS (SELECT *, 0 AS label FROM meta UNION ALL SELECT *, 1 FROM meta WHERE case_id IN """ + CASES + ")"
VARS = ["anestart", "male", "seg"]


def _per_var(body: str, sep=" UNION ALL ") -> str:
    return sep.join(body.replace("{v}", v).replace("{kind}", "binary" if v == "male" else "numeric").replace(
        "{test}", "Fisher''s Exact" if v == "male" else "Welch''s t-test") for v in VARS)


_T = """(avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0)) / sqrt(var_samp(x) FILTER (label = 1) / count(x) FILTER (label = 1) + var_samp(x) FILTER (label = 0) / count(x) FILTER (label = 0))"""

QUERIES = {
    "e23_mean_spectrum": (
        lambda s, d: _r(S.mean_spectrum(spectra_rows(s, d), ["set"], "std"), "mean", "std"),
        f"WITH {SPECTRA} SELECT set, freq_hz, round(avg(psd), 6) AS mean, round(stddev_pop(psd), 6) AS std, count(*) AS n FROM spec GROUP BY ALL"),
    "e23_mean_spectrum_sem": (
        lambda s, d: _r(S.mean_spectrum(spectra_rows(s, d), ["set"], "sem"), "mean", "sem"),
        f"WITH {SPECTRA} SELECT set, freq_hz, round(avg(psd), 6) AS mean, round(stddev_pop(psd) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM spec GROUP BY ALL"),
    "e24_median_spectrum": (
        lambda s, d: _r(S.median_spectrum(spectra_rows(s, d)), "median", "mad", "median_db", "upper_db", "lower_db"),
        f"""WITH {SPECTRA}, m AS (SELECT set, freq_hz, quantile_cont(psd, 0.5) AS md FROM spec GROUP BY ALL),
        a AS (SELECT set, freq_hz, any_value(md) AS md, quantile_cont(abs(psd - md), 0.5) AS ad FROM spec JOIN m USING (set, freq_hz) GROUP BY ALL)
        SELECT set, freq_hz, round(md, 6) AS median, round(ad, 6) AS mad, round(CASE WHEN md > 0 THEN 10 * log10(md) END, 6) AS median_db,
          round(CASE WHEN md + ad > 0 THEN 10 * log10(md + ad) END, 6) AS upper_db, round(CASE WHEN md - ad > 0 THEN 10 * log10(md - ad) END, 6) AS lower_db FROM a"""),
    "e25_auroc": (
        lambda s, d: _r(S.auroc_bootstrap(equal_pairs(s, d), ["pair", "freq_hz"], "psd", 200, rows_per_chunk=200).select("pair", "freq_hz", "auroc", "strong"), "auroc"),
        f"""WITH {PAIRS}, au AS (SELECT pair, freq_hz, (w - n1 * (n1 + 1) / 2) / (n1 * n0) AS a FROM ws)
        SELECT pair, freq_hz, round(a, 6) AS auroc, a >= 0.7 OR a <= 0.3 AS strong FROM au"""),
    "e25_auroc_bootstrap": (
        lambda s, d: S.auroc_bootstrap(equal_pairs(s, d), ["pair", "freq_hz"], "psd", 10_000, rows_per_chunk=200), None),
    "e26_rank_sum": (
        lambda s, d: _r(S.rank_sum(equal_pairs(s, d), ["pair", "freq_hz"], "psd").drop("p_value"), "z"),
        f"""WITH {PAIRS} SELECT pair, freq_hz, n1, n0, w AS rank_sum,
        round((w - n1 * (n1 + n0 + 1) / 2 - 0.5 * sign(w - n1 * (n1 + n0 + 1) / 2)) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z FROM ws"""),
    "e27_pairwise_comparison": (
        lambda s, d: S.compare_sets(three_sets(s, d), NAMES, ["case_id", "start", "end"]), None),
    "e27_equal_sized_pairs": (
        lambda s, d: equal_pairs(s, d).groupBy("pair", "label").agg(F.countDistinct("start").alias("n_epochs"), F.round(F.sum("psd"), 4).alias("psd_sum")),
        f"""WITH {PAIRS} SELECT pair, label, count(DISTINCT start) AS n_epochs, round(sum(psd), 4) AS psd_sum FROM eq GROUP BY ALL"""),
    "e28_feature_differences": (
        lambda s, d: _r(S.feature_differences(I.labelled(s, d), COLS).drop("p_value"), "mean_1", "mean_0", "mean_diff", "statistic", "cohen_d", n=5),
        f"WITH {I.LABELLED} " + " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(avg({c}) FILTER (label = 1), 5) AS mean_1, round(avg({c}) FILTER (label = 0), 5) AS mean_0,
        round(avg({c}) FILTER (label = 1) - avg({c}) FILTER (label = 0), 5) AS mean_diff, round({_T.replace('(x)', '(' + c + ')')}, 5) AS statistic,
        round((avg({c}) FILTER (label = 1) - avg({c}) FILTER (label = 0)) / sqrt(((count({c}) FILTER (label = 1) - 1) * var_samp({c}) FILTER (label = 1)
          + (count({c}) FILTER (label = 0) - 1) * var_samp({c}) FILTER (label = 0)) / (count({c}) - 2)), 5) AS cohen_d FROM labelled""" for c in COLS)),
    "e28_mann_whitney": (
        lambda s, d: S.feature_differences(I.labelled(s, d), COLS, "mannwhitney").select("feature", "statistic"),
        f"WITH {I.LABELLED} " + " UNION ALL ".join(f"""SELECT '{c}' AS feature, sum(r) AS statistic FROM (SELECT label, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r
        FROM labelled) WHERE label = 1""" for c in COLS)),
    "e28_feature_difference_p": (lambda s, d: S.feature_differences(I.labelled(s, d), COLS), None),
    "e29_outlier_means": (
        lambda s, d: _r(S.outlier_means(metadata(s, d), rich_suppliers(s, d), VARS, ["male"]), "outlier_mean", "full_mean", "difference"),
        f"WITH {META} " + _per_var("""SELECT '{v}' AS variable, '{kind}' AS type, round(avg({v}) FILTER (label = 1), 6) AS outlier_mean, round(avg({v}) FILTER (label = 0), 6) AS full_mean,
        round(avg({v}) FILTER (label = 1) - avg({v}) FILTER (label = 0), 6) AS difference FROM pooled""")),
    "e30_outlier_tests": (
        lambda s, d: S.outlier_tests(metadata(s, d), rich_suppliers(s, d), VARS).drop("p_value"),
        f"WITH {META} " + _per_var("""SELECT '{v}' AS variable, '{kind}' AS type, round(avg({v}) FILTER (label = 1), 4) AS outlier_mean, round(avg({v}) FILTER (label = 0), 4) AS full_mean,
        round(avg({v}) FILTER (label = 1) - avg({v}) FILTER (label = 0), 4) AS difference, '{test}' AS test FROM pooled""")),
    "e30_outlier_test_p": (lambda s, d: S.outlier_tests(metadata(s, d), rich_suppliers(s, d), VARS), None),
}
