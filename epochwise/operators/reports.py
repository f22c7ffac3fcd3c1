"""Evaluation reports over one table of predictions (``label, prediction, error``, groups, folds)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochwise.operators.keyed import numeric_columns
from epochwise.operators.ordered import cumulative, join_small, percentiles
from epochwise.session import materialize

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def with_error(df: DataFrame) -> DataFrame:
    return df.withColumn("error", (F.col("label") != F.col("prediction")).cast("int"))


def error_by_group(df: DataFrame, groups: Sequence[str], label: int | None = None) -> DataFrame:
    """E4, E5 (one label), E16 (groups = fold and group): totals, errors and error rate."""
    tail = "" if label is None else "_label"
    rows = df if label is None else df.filter(F.col("label") == label)
    total, wrong = F.count(F.lit(1)), F.sum(F.col("error").cast("long"))
    return rows.groupBy(*groups).agg(
        total.alias(f"total_samples{tail}"), wrong.alias(f"incorrect_predictions{tail}"), (wrong / total).alias(f"error_rate{tail}")
    )


def class_distribution(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per class and their share of the group."""
    n0, n1, n = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1), F.count(F.lit(1))
    return df.groupBy(*groups).agg(n0.alias("abs_0"), n1.alias("abs_1"), (n0 / n).alias("rel_0"), (n1 / n).alias("rel_1"))


def _moments(x: Column, y: Column) -> Column:
    return F.struct(F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("c"))


def correlation_with_error(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every numeric column with ``error``, null for constant columns.

    Pearson needs one pass over the table. Spearman takes the same on tie-averaged ranks.
    """
    columns = list(columns or numeric_columns(df))
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown correlation method {method!r}")
    if method == "spearman":
        # Ranks per distinct pair of values: equal rows are counted, not repeated; all columns go the same way at once.
        long = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col("error").alias("_y")).unpivot(["_y"], columns, "variable", "_x")
        pairs = long.groupBy("variable", "_x", "_y").agg(F.count(F.lit(1)).alias("w"))
        x, y = (cumulative(pairs, ["variable"], v, {"n": F.sum("w")}).select("variable", v, (F.col("n_below") + (F.col("n") + 1) / 2).alias(r)) for v, r in (("_x", "rx"), ("_y", "ry")))
        r = pairs.join(x, ["variable", "_x"]).join(y, ["variable", "_y"])
        w = F.sum("w")
        mx, my = F.sum(F.col("w") * F.col("rx")) / w, F.sum(F.col("w") * F.col("ry")) / w
        cov = F.sum(F.col("w") * F.col("rx") * F.col("ry")) / w - mx * my
        vx = F.sum(F.col("w") * F.col("rx") * F.col("rx")) / w - mx * mx
        vy = F.sum(F.col("w") * F.col("ry") * F.col("ry")) / w - my * my
        ok = (vx > 1e-12) & (vy > 1e-12)
        return r.groupBy("variable").agg(F.when(ok, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).alias("correlation"))
    e = F.col("error").cast("double")
    one = df.agg(*[_moments(F.col(c).cast("double"), e).alias(c) for c in columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("m")) for c in columns])).alias("r"))
    # A constant column has no correlation; compare spreads with zero before dividing.
    spread = F.col("r.m.sx") * F.col("r.m.sy")
    return rows.select(F.col("r.variable").alias("variable"), F.when(spread > 1e-12, F.try_divide(F.col("r.m.c"), spread)).alias("correlation"))


def confusion_by_group(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The four cells per group, label order 0, 1."""
    def cell(t: int, p: int) -> Column:
        return F.count_if((F.col("label") == t) & (F.col("prediction") == p))

    return df.groupBy(*groups).agg(
        cell(0, 0).alias("true_0_pred_0"), cell(0, 1).alias("true_0_pred_1"),
        cell(1, 0).alias("true_1_pred_0"), cell(1, 1).alias("true_1_pred_1"),
    )


def imperfect_groups(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Groups with at least one error."""
    return error_by_group(df, groups).filter("error_rate > 0")


def temporal_error(df: DataFrame, group: str, n: int = 10, time: str = "start") -> DataFrame:
    """The error series of the ``n`` groups with the highest error rate."""
    worst = error_by_group(df, [group]).orderBy(F.col("error_rate").desc(), group).limit(n).select(group)
    return df.join(worst, group, "left_semi").select(group, time, "error")


def roc_auc(df: DataFrame, by: Sequence[str], score: str = "score", name: str = "roc_auc") -> DataFrame:
    """Exact area under the ROC curve from tie-averaged ranks; null when a class is absent."""
    c = cumulative(df, by, score, {"n": F.count(F.lit(1)), "p": F.sum(F.col("label").cast("long"))})
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    pos, tot = F.max("p_total"), F.max("n_total")
    u = F.sum(F.col("p") * rank) - pos * (pos + 1) / 2
    return c.groupBy(*by).agg(F.try_divide(u, (pos * (tot - pos)).cast("double")).alias(name))


def roc_curve(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """(fpr, tpr) when every row with at least the given score is called positive."""
    c = cumulative(df, by, score, {"n": F.count(F.lit(1)), "p": F.sum(F.col("label").cast("long"))})
    tp = F.col("p_total") - F.col("p_below")
    fp = (F.col("n_total") - F.col("p_total")) - (F.col("n_below") - F.col("p_below"))
    return c.select(
        *by, F.col(score).alias("threshold"),
        F.try_divide(fp.cast("double"), (F.col("n_total") - F.col("p_total")).cast("double")).alias("fpr"),
        F.try_divide(tp.cast("double"), F.col("p_total").cast("double")).alias("tpr"),
    )


def fold_metrics(df: DataFrame, by: Sequence[str] = ("fold",), score: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on an empty denominator) and AUC per fold, 4 decimals."""
    by = list(by)
    cells = confusion_by_group(df, by)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("true_0_pred_0", "true_0_pred_1", "true_1_pred_0", "true_1_pred_1"))

    def share(a: Column, b: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)

    out = cells.select(
        *by, share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "true_0_pred_0", "true_0_pred_1", "true_1_pred_0", "true_1_pred_1",
    )
    if score is None:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    auc = roc_auc(df, by, score).withColumn("roc_auc", F.round("roc_auc", 4))
    return join_small(out, auc, by)


def metric_summary(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds, nulls skipped."""
    long = metrics.unpivot(list(by), METRICS, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("standard_deviation"))


def confusion_cells(metrics: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """The cells in long form: count and share of the true class in percent."""
    cells = ["true_0_pred_0", "true_0_pred_1", "true_1_pred_0", "true_1_pred_1"]
    long = metrics.select(*by, *[F.col(c).cast("double") for c in cells], *[
        (F.col(f"true_{t}_pred_0") + F.col(f"true_{t}_pred_1")).cast("double").alias(f"_row{t}") for t in (0, 1)
    ]).unpivot([*by, "_row0", "_row1"], cells, "cell", "n")
    row = F.when(F.col("cell").startswith("true_0"), F.col("_row0")).otherwise(F.col("_row1"))
    return long.select(*by, "cell", "n", (F.try_divide(F.col("n"), row) * 100).alias("percent"))


def confusion_summary(metrics: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Mean and spread over the folds, of the percentages and of the counts."""
    return confusion_cells(metrics, by).groupBy("cell").agg(
        F.avg("percent").alias("mean_percent"), F.stddev_pop("percent").alias("std_percent"),
        F.avg("n").alias("mean_count"), F.stddev_pop("n").alias("std_count"),
    )


def error_matrix(errors: DataFrame, group: str, values: Sequence) -> DataFrame:
    """Fold by group matrix of error rates for a given list of groups.

    Without a list of columns the long form of :func:`error_by_group` is the result to use.
    """
    return errors.groupBy("fold").pivot(group, list(values)).agg(F.first("error_rate"))


def tukey_threshold(errors: DataFrame, k: float = 1.5, rate: str = "error_rate") -> DataFrame:
    """One row with ``min(q3 + k * (q3 - q1), 1)``."""
    q = percentiles(errors, [], rate, {"q1": 0.25, "q3": 0.75})
    return q.select(F.least(F.col("q3") + k * (F.col("q3") - F.col("q1")), F.lit(1.0)).alias("error_threshold"))


def outlier_groups(
    errors: DataFrame, min_errors: int = 5, threshold: float | str = "iqr", k: float = 1.5,
    rate: str = "error_rate", wrong: str = "incorrect_predictions",
) -> DataFrame:
    """Groups with many errors and an error rate at or above the threshold."""
    if threshold == "iqr":
        marked = join_small(errors, tukey_threshold(errors, k, rate), [])
    elif isinstance(threshold, float):
        marked = errors.withColumn("error_threshold", F.lit(threshold))
    else:
        raise ValueError("a threshold is a number or iqr")
    return marked.filter((F.col(rate) >= F.col("error_threshold")) & (F.col(wrong) >= min_errors))


def epoch_distribution(splits: DataFrame, names: dict[int, str], keys: Sequence[str] = ("case_id", "start", "end")) -> DataFrame:
    """Distinct epochs over all folds, counted per case and class name."""
    once = splits.dropDuplicates(list(keys))
    return once.groupBy("case_id").agg(*[F.count_if(F.col("label") == v).alias(n) for v, n in names.items()])


def run_metric_table(summaries: DataFrame, metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1"), prefix: str = "zscorenorm2_") -> DataFrame:
    """One row per run, metric means in percent; the run name loses its common prefix."""
    named = summaries.withColumn("run", F.regexp_replace("run", f"^{prefix}", ""))
    return named.groupBy("run").agg(*[
        (F.max(F.when(F.col("metric") == m, F.col("mean"))) * 100).alias(m.capitalize()) for m in metrics
    ])


def feature_count(run: str = "run") -> Column:
    """Features named in a run; each letter after ``band`` is one feature."""
    one = lambda p: F.when(p.startswith("band"), F.length(F.regexp_replace(p, "band", ""))).otherwise(F.lit(1))
    return F.aggregate(F.transform(F.split(run, "_"), one), F.lit(0), lambda a, x: a + x)


def best_and_worst(runs: DataFrame, metric: str = "Accuracy") -> DataFrame:
    """Best and worst run per number of features."""
    r = runs.withColumn("num_features", feature_count())
    return r.groupBy("num_features").agg(
        F.max_by("run", F.struct(F.col(metric), F.col("run"))).alias("best_run"), F.max(metric).alias("best_score"),
        F.min_by("run", F.struct(F.col(metric), F.col("run"))).alias("worst_run"), F.min(metric).alias("worst_score"),
    )


def top_and_bottom_runs(summaries: DataFrame, metric: str = "accuracy", n: int = 5) -> DataFrame:
    """The ``n`` best and ``n`` worst runs by mean; a run may be in both parts."""
    s = summaries.filter(F.col("metric") == metric).select("run", F.col("mean").alias("score"))
    top = s.orderBy(F.col("score").desc(), "run").limit(n).withColumn("part", F.lit("top"))
    low = s.orderBy(F.col("score").asc(), F.col("run").desc()).limit(n).withColumn("part", F.lit("bottom"))
    return top.unionByName(low)


def sample_size_report(results: DataFrame) -> DataFrame:
    """Mean and standard error in percent per sample size and metric."""
    return results.groupBy("size", "metric").agg(
        (F.avg("value") * 100).alias("mean"), (F.stddev_pop("value") / F.sqrt(F.count("value")) * 100).alias("std_error")
    )


def result_bundle(predictions: DataFrame, group: str, label: int = 1) -> dict[str, DataFrame]:
    """All reports for one metadata column."""
    fold_group = ["fold", group]
    errors = error_by_group(predictions, fold_group)
    return {
        "error": errors,
        "error_label": error_by_group(predictions, fold_group, label),
        "class_distribution": class_distribution(predictions, fold_group),
        "confusion": confusion_by_group(predictions, fold_group),
        "correlation": correlation_with_error(predictions),
        "outlier_groups": outlier_groups(errors),
        "metrics": fold_metrics(predictions),
    }


def _rates(cells: DataFrame, by: list[str], tail: str = "") -> DataFrame:
    total, wrong = F.sum("n"), F.sum(F.when(F.col("label") != F.col("prediction"), F.col("n")).otherwise(0))
    return cells.groupBy(*by).agg(total.alias(f"total_samples{tail}"), wrong.alias(f"incorrect_predictions{tail}"), (wrong / total).alias(f"error_rate{tail}"))


def result_bundles(
    predictions: DataFrame, groups: Sequence[str], label: int = 1, numeric: Sequence[str] | None = None, worst: int = 10, time: str = "start", min_errors: int = 5, k: float = 1.5,
    splits: DataFrame | None = None, names: dict[int, str] | None = None,
) -> dict[str, DataFrame]:
    """All reports for all metadata columns ``groups`` at once; they are told apart by ``variable``, their groups by ``value`` (as text).

    The predictions are read twice. In the first pass every row counts once for each column, towards the number of rows of a
    ``(variable, value, fold, label, prediction)``; numeric columns bring mean and spread. That table is stored and gives

    ``error`` (E4), ``error_label`` (E5), ``error_by_fold`` (E16, the long form of E17), ``error_label_by_fold``, ``class_distribution`` (E6), ``confusion`` (E8),
    ``imperfect`` (E9), ``outlier_groups`` (E18, E19, per variable), ``metrics`` (E11 per fold), ``imbalance`` (D11), ``correlation`` (E7).

    The second pass fetches the error series of the ``worst`` groups of each column: ``temporal_error`` (E10). With ``splits`` there is
    ``epoch_distribution`` (E20). Rows without a value in a column are a group of their own.
    """
    groups = list(groups)
    numeric = [c for c in (numeric if numeric is not None else numeric_columns(predictions, ["error"])) if c != "error"]
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = [F.struct(F.lit(c).alias("variable"), F.lit(True).alias("grouped"), F.col(c).cast("string").alias("value"), none.alias("x")) for c in groups]
    entries += [F.struct(F.lit(c).alias("variable"), F.lit(False).alias("grouped"), text.alias("value"), F.col(c).cast("double").alias("x")) for c in numeric]
    each = predictions.select("fold", "label", "prediction", F.explode(F.array(*entries)).alias("_e")).select("fold", "label", "prediction", "_e.*")
    cells = each.groupBy("variable", "grouped", "value", "fold", "label", "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("nx"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    cells = materialize(cells, "cells")
    g = cells.filter("grouped").drop("grouped", "nx", "m", "v")
    key, by_fold = ["variable", "value"], ["variable", "value", "fold"]
    n0, n1 = (F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)) for c in (0, 1))
    n = F.sum("n")
    shares = g.groupBy(*by_fold).agg(n0.alias("abs_0"), n1.alias("abs_1"), (n0 / n).alias("rel_0"), (n1 / n).alias("rel_1"))
    four = [F.sum(F.when((F.col("label") == t) & (F.col("prediction") == p), F.col("n")).otherwise(0)).alias(f"true_{t}_pred_{p}") for t in (0, 1) for p in (0, 1)]
    errors, errors_by_fold = _rates(g, key), _rates(g, by_fold)
    # Every column counts every row, so one of them gives the folds' cells.
    folds = g.filter(F.col("variable") == groups[0]).groupBy("fold").agg(*four)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("true_0_pred_0", "true_0_pred_1", "true_1_pred_0", "true_1_pred_1"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    metrics = folds.select(
        "fold", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "true_0_pred_0", "true_0_pred_1", "true_1_pred_0", "true_1_pred_1")
    imbalance = shares.groupBy("variable", "fold").agg(F.avg("rel_0").alias("rel_0"), F.avg("rel_1").alias("rel_1")).join(metrics.select("fold", "accuracy", "precision", "recall"), "fold")
    quartiles = percentiles(errors_by_fold, ["variable"], "error_rate", {"q1": 0.25, "q3": 0.75})
    limit = quartiles.select("variable", F.least(F.col("q3") + k * (F.col("q3") - F.col("q1")), F.lit(1.0)).alias("error_threshold"))
    outliers = errors_by_fold.join(limit, "variable").filter((F.col("error_rate") >= F.col("error_threshold")) & (F.col("incorrect_predictions") >= min_errors))
    # Moments of the numeric columns: a few rows a column, one for each fold, label and prediction.
    e = (F.col("label") != F.col("prediction")).cast("double")
    whole = W.partitionBy("variable")
    parts = cells.filter("NOT grouped AND nx > 0").withColumns({"e": e, "all": F.sum("nx").over(whole)})
    parts = parts.withColumns({"mx": F.sum(F.col("m") * F.col("nx")).over(whole) / F.col("all"), "me": F.sum(F.col("e") * F.col("nx")).over(whole) / F.col("all")})
    dx, de = F.col("m") - F.col("mx"), F.col("e") - F.col("me")
    sums = parts.groupBy("variable").agg(F.sum(F.col("nx") * (F.col("v") + dx * dx)).alias("xx"), F.sum(F.col("nx") * de * de).alias("ee"), F.sum(F.col("nx") * dx * de).alias("xe"), F.max("all").alias("all"))
    spread = F.sqrt("xx") * F.sqrt("ee")
    correlation = sums.select("variable", F.when(spread / F.col("all") > 1e-12, F.col("xe") / spread).alias("correlation"))
    out = {
        "error": errors, "error_label": _rates(g.filter(F.col("label") == label), key, "_label"), "error_by_fold": errors_by_fold,
        "error_label_by_fold": _rates(g.filter(F.col("label") == label), by_fold, "_label"), "class_distribution": shares, "confusion": g.groupBy(*key).agg(*four),
        "imperfect": errors.filter("error_rate > 0"), "outlier_groups": outliers, "metrics": metrics, "imbalance": imbalance, "correlation": correlation,
    }
    if time in predictions.columns:
        # At most ``worst`` rows for each column.
        top = None
        for c in groups:
            own = errors.filter(F.col("variable") == c).orderBy(F.col("error_rate").desc(), F.col("value")).limit(worst).select("variable", "value")
            top = own if top is None else top.unionByName(own)
        series = predictions.select(F.col(time), "error", F.explode(F.array(*entries[: len(groups)])).alias("_e")).select("_e.variable", "_e.value", time, "error")
        top = top.select(F.col("variable").alias("_v"), F.col("value").alias("_w"))
        out["temporal_error"] = series.join(F.broadcast(top), (F.col("variable") == F.col("_v")) & F.col("value").eqNullSafe(F.col("_w")), "left_semi")
    if splits is not None:
        out["epoch_distribution"] = epoch_distribution(splits, names or {0: "class_0", 1: "class_1"})
    return out
