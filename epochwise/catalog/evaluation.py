"""Evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.catalog import inputs as I
from epochwise.catalog.relations import FOLDS, folds
from epochwise.operators import reports as R
from epochwise.operators.keyed import imbalance_vs_metric

L, J = I.LABELLED, I.JUDGED


def _r(df, *cols, n=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def metrics(s, d):
    return R.fold_metrics(I.labelled(s, d), ["fold"], "score")


_AUC = """ranked AS (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2 AS rk FROM labelled),
auc AS (SELECT {by}, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
  / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS roc_auc FROM ranked GROUP BY {by})"""


def metrics_sql(by: str) -> str:
    return L + f""", cells AS (SELECT {by}, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM labelled GROUP BY {by}),
""" + _AUC.format(by=by) + f""", metrics AS (SELECT c.{by}, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, tn AS true_0_pred_0, fp AS true_0_pred_1, fn AS true_1_pred_0, tp AS true_1_pred_1,
  round(roc_auc, 4) AS roc_auc FROM cells c JOIN auc a ON c.{by} = a.{by})"""


def runs(s, d):
    """Summaries of seven runs: one per residue of the case id, named after feature combinations."""
    names = F.array(*[F.lit(n) for n in RUN_NAMES])
    df = I.labelled(s, d).withColumn("run", F.element_at(names, (F.pmod("case_id", F.lit(7)) + 1).cast("int")))
    return R.metric_summary(R.fold_metrics(df, ["run", "fold"], "score"), ["run"])


RUN_NAMES = ["zscorenorm2_skew", "zscorenorm2_kurt", "zscorenorm2_bandA_skew", "zscorenorm2_bandAT", "zscorenorm2_bandABDT_kurt_skew",
             "zscorenorm2_bandAB_perm_shan_skew", "zscorenorm2_perm"]
_NAMES = "[" + ", ".join(f"'{n}'" for n in RUN_NAMES) + "]"
RUNS = L + f""", lr AS (SELECT *, {_NAMES}[case_id % 7 + 1] AS run FROM labelled),
rc AS (SELECT run, fold, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM lr GROUP BY ALL),
rm AS (SELECT run, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM rc),
rs AS (SELECT run, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM rm GROUP BY run)"""

_ERR = "count(*) AS total_samples{t}, CAST(sum(error) AS BIGINT) AS incorrect_predictions{t}, round(sum(error) / count(*), 6) AS error_rate{t}"
NUM = ["n_chars", "toxic", "label", "prediction"]


def sample_results(s, d):
    """Accuracy per sample size and iteration, from the error column of the predictions."""
    p = I.labelled(s, d).withColumn("size", (F.col("case_id") % 4 + 1) * 50).withColumn("iteration", F.col("start") % 10)
    return p.groupBy("size", "iteration", F.lit("accuracy").alias("metric")).agg(F.avg(1.0 - F.col("error")).alias("value"))



GROUPS = ["case_id", "l_linestatus", "l_quantity"]
TALL = L + ", tall AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c if c != 'l_quantity' else 'CAST(l_quantity AS DOUBLE)'} AS VARCHAR) AS value, fold, start, label, prediction, error FROM labelled" for c in GROUPS) + ")"
_CELLS = ", ".join(f"count(*) FILTER (label = {t} AND prediction = {p}) AS true_{t}_pred_{p}" for t in (0, 1) for p in (0, 1))
_MET = f"""met AS (SELECT fold, round((t1 + t0) / n, 4) AS accuracy, round(coalesce(t1 / nullif(t1 + f1, 0), 0), 4) AS precision, round(coalesce(t1 / nullif(t1 + f0, 0), 0), 4) AS recall,
  round(coalesce(2 * t1 / nullif(2 * t1 + f1 + f0, 0), 0), 4) AS f1, t0 AS true_0_pred_0, c.f1 AS true_0_pred_1, f0 AS true_1_pred_0, t1 AS true_1_pred_1 FROM
  (SELECT fold, count(*) AS n, count(*) FILTER (label = 0 AND prediction = 0) AS t0, count(*) FILTER (label = 0 AND prediction = 1) AS f1,
    count(*) FILTER (label = 1 AND prediction = 0) AS f0, count(*) FILTER (label = 1 AND prediction = 1) AS t1 FROM labelled GROUP BY fold) c)"""


def bundle(report: str, *rounded: str):
    """One report of the bundle over several columns."""
    def run(s, d):
        rows = I.labelled(s, d).withColumn("l_quantity", F.col("l_quantity").cast("double"))
        return _r(R.result_bundles(rows, GROUPS, numeric=["l_quantity", "l_extendedprice", "score", "label"], k=0.3)[report], *rounded)

    return run


QUERIES = {
    "e4_error_by_group": (
        lambda s, d: _r(R.error_by_group(I.judged(s, d), ["lang"]), "error_rate"), f"WITH {J} SELECT lang, {_ERR.format(t='')} FROM judged GROUP BY lang"),
    "e5_error_of_label_by_group": (
        lambda s, d: _r(R.error_by_group(I.judged(s, d), ["source"], 1), "error_rate_label"),
        f"WITH {J} SELECT source, {_ERR.format(t='_label')} FROM judged WHERE label = 1 GROUP BY source"),
    "e6_class_distribution": (
        lambda s, d: _r(R.class_distribution(I.judged(s, d), ["source"]), "rel_0", "rel_1"),
        f"""WITH {J} SELECT source, count(*) FILTER (label = 0) AS abs_0, count(*) FILTER (label = 1) AS abs_1,
        round(count(*) FILTER (label = 0) / count(*), 6) AS rel_0, round(count(*) FILTER (label = 1) / count(*), 6) AS rel_1 FROM judged GROUP BY source"""),
    "e7_correlation_pearson": (
        lambda s, d: _r(R.correlation_with_error(I.judged(s, d), "pearson", NUM), "correlation"),
        f"WITH {J} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr({c}, error), 6) AS correlation FROM judged" for c in NUM)),
    "e7_correlation_spearman": (
        lambda s, d: _r(R.correlation_with_error(I.judged(s, d), "spearman", NUM[:3]), "correlation"),
        f"WITH {J}, rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in [*NUM[:3], "error"])
        + " FROM judged) " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr({c}, error), 6) AS correlation FROM rk" for c in NUM[:3])),
    "e8_confusion_by_group": (
        lambda s, d: R.confusion_by_group(I.judged(s, d), ["lang", "source"]),
        f"WITH {J} SELECT lang, source, " + ", ".join(f"count(*) FILTER (label = {t} AND prediction = {p}) AS true_{t}_pred_{p}" for t in (0, 1) for p in (0, 1))
        + " FROM judged GROUP BY ALL"),
    "e9_imperfect_groups": (
        lambda s, d: _r(R.imperfect_groups(I.judged(s, d), ["source"]), "error_rate"), f"WITH {J} SELECT source, {_ERR.format(t='')} FROM judged GROUP BY source HAVING sum(error) > 0"),
    "e10_temporal_error": (
        lambda s, d: R.temporal_error(I.labelled(s, d), "case_id", 10),
        f"""WITH {L}, w AS (SELECT case_id FROM labelled GROUP BY case_id ORDER BY sum(error) / count(*) DESC, case_id LIMIT 10)
        SELECT case_id, start, error FROM labelled WHERE case_id IN (FROM w)"""),
    "e11_fold_metrics": (metrics, f"WITH {metrics_sql('fold')} SELECT * FROM metrics"),
    "e12_roc_auc": (
        lambda s, d: _r(R.roc_auc(I.labelled(s, d), ["case_id"]), "roc_auc"),
        f"WITH {L}, {_AUC.format(by='case_id')} SELECT case_id, round(roc_auc, 6) AS roc_auc FROM auc"),
    "e13_roc_curve": (
        lambda s, d: _r(R.roc_curve(I.labelled(s, d), ["fold"]), "fpr", "tpr"),
        f"""WITH {L}, g AS (SELECT fold, score, count(*) AS n, sum(label) AS p FROM labelled GROUP BY ALL)
        SELECT fold, score AS threshold, round(sum(n - p) OVER w / sum(n - p) OVER t, 6) AS fpr, round(sum(p) OVER w / sum(p) OVER t, 6) AS tpr
        FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC), t AS (PARTITION BY fold)"""),
    "e14_fold_summary": (
        lambda s, d: _r(R.metric_summary(metrics(s, d)), "mean", "standard_deviation"),
        f"WITH {metrics_sql('fold')} " + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS standard_deviation FROM metrics" for m in R.METRICS)),
    "e15_confusion_cells": (
        lambda s, d: _r(R.confusion_cells(R.fold_metrics(I.labelled(s, d))), "percent"),
        f"WITH {metrics_sql('fold')} " + " UNION ALL ".join(
            f"SELECT fold, 'true_{t}_pred_{p}' AS cell, CAST(true_{t}_pred_{p} AS DOUBLE) AS n, round(true_{t}_pred_{p} / (true_{t}_pred_0 + true_{t}_pred_1) * 100, 6) AS percent FROM metrics"
            for t in (0, 1) for p in (0, 1))),
    "e15_confusion_summary": (
        lambda s, d: _r(R.confusion_summary(R.fold_metrics(I.labelled(s, d))), "mean_percent", "std_percent", "mean_count", "std_count", n=4),
        f"WITH {metrics_sql('fold')} " + " UNION ALL ".join(
            f"""SELECT 'true_{t}_pred_{p}' AS cell, round(avg(true_{t}_pred_{p} / (true_{t}_pred_0 + true_{t}_pred_1) * 100), 4) AS mean_percent,
            round(stddev_pop(true_{t}_pred_{p} / (true_{t}_pred_0 + true_{t}_pred_1) * 100), 4) AS std_percent,
            round(avg(true_{t}_pred_{p}), 4) AS mean_count, round(stddev_pop(true_{t}_pred_{p}), 4) AS std_count FROM metrics""" for t in (0, 1) for p in (0, 1))),
    "e16_error_by_fold_and_group": (
        lambda s, d: _r(R.error_by_group(I.labelled(s, d), ["fold", "case_id"]), "error_rate"),
        f"WITH {L} SELECT fold, case_id, {_ERR.format(t='')} FROM labelled GROUP BY ALL"),
    "e17_fold_group_matrix": (
        lambda s, d: _r(R.error_matrix(R.error_by_group(I.labelled(s, d).withColumn("fold", F.col("end") % 6), ["fold", "l_linestatus"]), "l_linestatus", ["F", "O"]), "F", "O"),
        f"""WITH {L} SELECT "end" % 6 AS fold, round(avg(error) FILTER (l_linestatus = 'F'), 6) AS "F", round(avg(error) FILTER (l_linestatus = 'O'), 6) AS "O" FROM labelled GROUP BY 1"""),
    "e18_tukey_threshold": (
        lambda s, d: _r(R.tukey_threshold(R.error_by_group(I.labelled(s, d), ["case_id"])), "error_threshold"),
        f"""WITH {L}, e AS (SELECT sum(error) / count(*) AS r FROM labelled GROUP BY case_id), q AS (SELECT quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.75) AS b FROM e)
        SELECT round(least(b + 1.5 * (b - a), 1.0), 6) AS error_threshold FROM q"""),
    "e19_outlier_groups": (
        lambda s, d: _r(R.outlier_groups(R.error_by_group(I.labelled(s, d), ["fold", "case_id"]), 5, "iqr", 0.3), "error_rate", "error_threshold"),
        f"""WITH {L}, e AS (SELECT fold, case_id, {_ERR.format(t='').replace('round(', '(').replace(', 6)', ')')} FROM labelled GROUP BY ALL),
        q AS (SELECT quantile_cont(error_rate, 0.25) AS a, quantile_cont(error_rate, 0.75) AS b FROM e)
        SELECT fold, case_id, total_samples, incorrect_predictions, round(error_rate, 6) AS error_rate, round(least(b + 0.3 * (b - a), 1.0), 6) AS error_threshold
        FROM e, q WHERE error_rate >= least(b + 0.3 * (b - a), 1.0) AND incorrect_predictions >= 5"""),
    "e20_epoch_distribution": (
        lambda s, d: R.epoch_distribution(folds(s, d), {0: "faw", 1: "awake"}),
        f"""WITH {FOLDS}, u AS (SELECT DISTINCT case_id, start, "end", label FROM folds)
        SELECT case_id, count(*) FILTER (label = 0) AS faw, count(*) FILTER (label = 1) AS awake FROM u GROUP BY 1"""),
    "d11_imbalance_vs_metric": (
        lambda s, d: _r(imbalance_vs_metric(R.class_distribution(I.labelled(s, d), ["fold", "case_id"]), metrics(s, d), "accuracy"), "rel_0", "rel_1"),
        f"""WITH {metrics_sql('fold')}, sh AS (SELECT fold, case_id, count(*) FILTER (label = 0) / count(*) AS r0, count(*) FILTER (label = 1) / count(*) AS r1 FROM labelled GROUP BY ALL)
        SELECT s.fold, round(avg(r0), 6) AS rel_0, round(avg(r1), 6) AS rel_1, max(accuracy) AS accuracy FROM sh s JOIN metrics m ON s.fold = m.fold GROUP BY 1"""),
    "e31_run_metric_table": (
        lambda s, d: _r(R.run_metric_table(runs(s, d)), "Accuracy", "Precision", "Recall", "F1", n=4),
        f"""WITH {RUNS} SELECT replace(run, 'zscorenorm2_', '') AS run, round(accuracy * 100, 4) AS "Accuracy", round(precision * 100, 4) AS "Precision",
        round(recall * 100, 4) AS "Recall", round(f1 * 100, 4) AS "F1" FROM rs"""),
    "e32_best_and_worst_runs": (
        lambda s, d: _r(R.best_and_worst(R.run_metric_table(runs(s, d))), "best_score", "worst_score", n=4),
        f"""WITH {RUNS}, t AS (SELECT replace(run, 'zscorenorm2_', '') AS run, accuracy * 100 AS a FROM rs),
        c AS (SELECT *, CAST(list_sum(list_transform(string_split(run, '_'), lambda p: CASE WHEN starts_with(p, 'band') THEN length(p) - 4 ELSE 1 END)) AS INT) AS num_features FROM t)
        SELECT num_features, max_by(run, (a, run)) AS best_run, round(max(a), 4) AS best_score, min_by(run, (a, run)) AS worst_run, round(min(a), 4) AS worst_score FROM c GROUP BY 1"""),
    "e33_sample_size_report": (
        lambda s, d: _r(R.sample_size_report(sample_results(s, d)), "mean", "std_error", n=4),
        f"""WITH {L}, v AS (SELECT (case_id % 4 + 1) * 50 AS size, start % 10 AS it, avg(1.0 - error) AS value FROM labelled GROUP BY ALL)
        SELECT size, 'accuracy' AS metric, round(avg(value) * 100, 4) AS mean, round(stddev_pop(value) / sqrt(count(*)) * 100, 4) AS std_error FROM v GROUP BY size"""),
    "g2_top_and_bottom_runs": (
        lambda s, d: _r(R.top_and_bottom_runs(runs(s, d), "accuracy", 2), "score"),
        f"""WITH {RUNS} (SELECT run, round(accuracy, 6) AS score, 'top' AS part FROM rs ORDER BY accuracy DESC, run LIMIT 2)
        UNION ALL (SELECT run, round(accuracy, 6) AS score, 'bottom' AS part FROM rs ORDER BY accuracy, run DESC LIMIT 2)"""),
    "n2_error_bundle_label": (
        lambda s, d: _r(R.result_bundle(I.labelled(s, d), "case_id")["error_label"], "error_rate_label"),
        f"WITH {L} SELECT fold, case_id, {_ERR.format(t='_label')} FROM labelled WHERE label = 1 GROUP BY ALL"),
    "n2_error": (bundle("error", "error_rate"), f"WITH {TALL} SELECT variable, value, {_ERR.format(t='')} FROM tall GROUP BY ALL"),
    "n2_error_label": (bundle("error_label", "error_rate_label"), f"WITH {TALL} SELECT variable, value, {_ERR.format(t='_label')} FROM tall WHERE label = 1 GROUP BY ALL"),
    "n2_error_by_fold": (bundle("error_by_fold", "error_rate"), f"WITH {TALL} SELECT variable, value, fold, {_ERR.format(t='')} FROM tall GROUP BY ALL"),
    "n2_class_distribution": (
        bundle("class_distribution", "rel_0", "rel_1"), f"""WITH {TALL} SELECT variable, value, fold, count(*) FILTER (label = 0) AS abs_0, count(*) FILTER (label = 1) AS abs_1,
        round(count(*) FILTER (label = 0) / count(*), 6) AS rel_0, round(count(*) FILTER (label = 1) / count(*), 6) AS rel_1 FROM tall GROUP BY ALL"""),
    "n2_confusion": (bundle("confusion"), f"WITH {TALL} SELECT variable, value, {_CELLS} FROM tall GROUP BY ALL"),
    "n2_imperfect_groups": (bundle("imperfect", "error_rate"), f"WITH {TALL} SELECT variable, value, {_ERR.format(t='')} FROM tall GROUP BY ALL HAVING sum(error) > 0"),
    "n2_outlier_groups": (
        bundle("outlier_groups", "error_rate", "error_threshold"), f"""WITH {TALL}, e AS (SELECT variable, value, fold, count(*) AS total_samples, CAST(sum(error) AS BIGINT) AS incorrect_predictions,
          sum(error) / count(*) AS error_rate FROM tall GROUP BY ALL),
        q AS (SELECT variable, least(quantile_cont(error_rate, 0.75) + 0.3 * (quantile_cont(error_rate, 0.75) - quantile_cont(error_rate, 0.25)), 1.0) AS t FROM e GROUP BY 1)
        SELECT variable, value, fold, total_samples, incorrect_predictions, round(error_rate, 6) AS error_rate, round(t, 6) AS error_threshold FROM e JOIN q USING (variable)
        WHERE error_rate >= t AND incorrect_predictions >= 5"""),
    "n2_fold_metrics": (bundle("metrics"), f"WITH {L}, {_MET} SELECT * FROM met"),
    "n2_imbalance_vs_metrics": (
        bundle("imbalance", "rel_0", "rel_1"), f"""WITH {TALL}, {_MET}, sh AS (SELECT variable, value, fold, count(*) FILTER (label = 0) / count(*) AS r0, count(*) FILTER (label = 1) / count(*) AS r1
          FROM tall GROUP BY ALL)
        SELECT variable, fold, round(avg(r0), 6) AS rel_0, round(avg(r1), 6) AS rel_1, max(accuracy) AS accuracy, max(precision) AS precision, max(recall) AS recall FROM sh JOIN met USING (fold) GROUP BY ALL"""),
    "n2_correlation": (
        bundle("correlation", "correlation"),
        f"WITH {L} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr({c}, error), 6) AS correlation FROM labelled" for c in ("l_quantity", "l_extendedprice", "score", "label"))),
    "n2_temporal_error": (
        bundle("temporal_error"), f"""WITH {TALL}, r AS (SELECT variable, value, sum(error) / count(*) AS rate FROM tall GROUP BY 1, 2),
        e AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY rate DESC, value) AS rn FROM r)
        SELECT variable, value, start, error FROM tall JOIN e USING (variable, value) WHERE rn <= 10"""),
}
