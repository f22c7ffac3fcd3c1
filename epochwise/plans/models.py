"""Classifiers, grids and sweeps of them, PCA, robust regions and k-means."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators.ordered import percentiles, take_random
from epochwise.operators.reports import fold_metrics, with_error
from epochwise.operators.signal import zscore_columns
from epochwise.plans import margins
from epochwise.plans.margins import MarginModel, Wanted
from epochwise.session import materialize


def train(df: DataFrame, features: Sequence[str], c: float = 1.0, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, probability: bool = True, **options) -> MarginModel:
    """M1: fit on feature columns and ``label``; ``c`` is the usual SVM cost, ``gamma`` defaults to 1 / (columns * variance).

    The probability's sigmoid is fitted on margins from models that have not seen the row. ``kernel_error`` of the result
    tells how far the features of the kernel are from it.
    """
    rows = margins.prepare(df, features)
    return margins.fit_many(rows, features, [Wanted("one", features, c, kernel, gamma, degree)], probability, **options)["one"]


def predict(model: MarginModel, df: DataFrame) -> DataFrame:
    """M1: test rows with ``prediction``, ``score`` (probability of class 1) and ``error``."""
    return with_error(margins.rated(df, {None: model}))


def evaluate_folds(
    splits: DataFrame, features: Sequence[str], c: float = 1.0, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, probability: bool = True, **options
) -> tuple[DataFrame, DataFrame]:
    """M3: train and predict per fold; returns all predictions and the metrics per fold. All folds are fitted in the same passes."""
    rows = margins.prepare(splits.filter("role = 'train'"), features, "fold")
    folds = list(margins.counts_of(rows))
    models = margins.fit_many(rows, features, [Wanted(f, features, c, kernel, gamma, degree, f) for f in folds], probability, **options)
    predictions = materialize(with_error(margins.rated(splits.filter("role = 'test'"), models, "fold")), "predictions")
    return predictions, fold_metrics(predictions, ["fold"], "score")


# The grid of the parameter search.
GRID = {"C": (0.1, 1.0, 10.0), "gamma": (0.01, 0.1, 1.0), "kernel": ("linear", "rbf", "poly")}


def grid_search(
    df: DataFrame, features: Sequence[str], fold_col: str, n_folds: int, grid: Mapping[str, Sequence] = GRID, metric: str = "accuracy", **options
) -> list[dict]:
    """M2: mean score of every combination over the given folds (0 to ``n_folds - 1``), best first; all are fitted in the same passes.

    The linear kernel has no gamma: it is fitted once and its rows have none. ``metric`` is one of accuracy,
    precision, recall and f1 of class 1. ``kernel_error`` is the largest error of the kernel's features.
    """
    if metric not in ("accuracy", "precision", "recall", "f1"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = margins.prepare(df, features, part=fold_col)
    cells = [(k, c, g) for k in grid["kernel"] for c in grid["C"] for g in (grid["gamma"] if k != "linear" else [None])]
    wanted = [Wanted((cell, f), features, cell[1], cell[0], cell[2], leave=f) for cell in cells for f in range(n_folds)]
    models = margins.fit_many(rows, features, wanted, probability=False, **options)
    found = margins.count_cells(rows, {name: (None, name[1], m) for name, m in models.items()}).collect()
    scores: dict = {}
    for r in found:
        cell, f = wanted[r["model"]].name
        tn, fp, fn, tp = r["tn"], r["fp"], r["fn"], r["tp"]
        share = {"accuracy": (tp + tn, tn + fp + fn + tp), "precision": (tp, tp + fp), "recall": (tp, tp + fn), "f1": (2 * tp, 2 * tp + fp + fn)}[metric]
        scores.setdefault(cell, []).append(share[0] / share[1] if share[1] else 0.0)
    results = [{
        "kernel": k, "C": c, "gamma": g, "score": sum(scores[k, c, g]) / len(scores[k, c, g]), "kernel_error": max(models[(k, c, g), f].kernel_error for f in range(n_folds)),
    } for k, c, g in cells]
    return sorted(results, key=lambda r: (-r["score"], r["kernel"], r["C"], r["gamma"] or 0.0))


def best_of_grid(df: DataFrame, features: Sequence[str], results: Sequence[Mapping], **options) -> MarginModel:
    """M2: the best combination of :func:`grid_search`, fitted on all rows."""
    top = results[0]
    return train(df, features, c=top["C"], kernel=top["kernel"], gamma=top["gamma"], **options)


# Short names of features in run names.
SHORT_NAMES = {"bandpower": "band", "spectral_skewness": "skew", "spectral_kurtosis": "kurt", "shannon_entropy": "shan", "permutation_entropy": "perm"}


def _run_name(features: Sequence[str], bands: Sequence[str], prefix: str) -> str:
    """Fixed format: short names in alphabetical order; band power carries its bands' first letters, sorted."""
    letters = "".join(sorted(band[0].upper() for band in bands))
    return prefix + "_".join(sorted(SHORT_NAMES[f] + letters if f == "bandpower" else SHORT_NAMES[f] for f in features))


def feature_combinations(features: Sequence[str] = tuple(SHORT_NAMES), bands: Sequence[str] = ("Alpha", "Beta", "Theta", "Delta"), prefix: str = "zscorenorm2_") -> list[dict]:
    """M7: all non-empty feature subsets, with band power for every non-empty band subset.

    A run is a number whose bits switch the columns: the bands, each a column of band power, and the other features.
    Every number above 0 names one run, so nothing is listed twice.
    """
    others = [f for f in features if f != "bandpower"]
    kept_bands = list(bands) if "bandpower" in features else []
    switches = [*kept_bands, *others]
    runs = []
    for number in range(1, 1 << len(switches)):
        on = {c for k, c in enumerate(switches) if number >> k & 1}
        in_bands = [b for b in kept_bands if b in on]
        chosen = [f for f in features if f in on or (f == "bandpower" and in_bands)]
        columns = [c for f in chosen for c in (in_bands if f == "bandpower" else [f])]
        runs.append({"run": _run_name(chosen, in_bands, prefix), "features": chosen, "bands": in_bands, "columns": columns})
    return sorted(runs, key=lambda r: (len(r["features"]), [list(features).index(f) for f in r["features"]], len(r["bands"]), [list(bands).index(b) for b in r["bands"]]))


def sweep(splits: DataFrame, combinations: Sequence[dict], c: float = 1.0, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, probability: bool = True, **options) -> DataFrame:
    """M7: metrics per run and fold for each column subset.

    All runs of all folds are fitted in the same passes over one table of rows. Test rows are rated by all
    runs of their fold at once.
    """
    features = list(dict.fromkeys(c for run in combinations for c in run["columns"]))
    rows = margins.prepare(splits.filter("role = 'train'"), features, "fold")
    folds = list(margins.counts_of(rows))
    wanted = [Wanted((r["run"], f), r["columns"], c, kernel, gamma, degree, f) for r in combinations for f in folds]
    models = margins.fit_many(rows, features, wanted, probability, **options)
    tests = margins.prepare(splits.filter("role = 'test'"), features, "fold")
    each = margins.rate_by_all(tests, features, [((run, f), f, m) for (run, f), m in models.items()])
    stored = materialize(each.select("model", F.col("y").cast("int").alias("label"), "prediction", "score"), "sweep")
    # One row for each model; rows are grouped by its number, not by names.
    names = splits.sparkSession.createDataFrame([(k, run, str(f)) for k, (run, f) in enumerate(models)], "model int, run string, fold string")
    names = names.withColumn("fold", F.col("fold").cast(splits.schema["fold"].dataType))
    metrics = fold_metrics(stored, ["model"], "score" if probability else None)
    return metrics.join(F.broadcast(names), "model").select("run", "fold", *[c for c in metrics.columns if c != "model"])


def sampling_experiment(
    train_rows: DataFrame, test_rows: DataFrame, samples: DataFrame, features: Sequence[str], train_on_sample: bool = False, c: float = 1.0, kernel: str = "linear",
    gamma: float | None = None, degree: int = 3, n_components: int = 256, error_bound: float = 0.05, max_iter: int = 60, seed: int = 42,
) -> DataFrame:
    """Metrics per sample size and iteration.

    (a) the sample only gives the z-score statistics, (b) the sample is also the training set.
    ``samples`` comes from ``splits.stratified_samples``. Experiments of (a) are models of one table, fitted in the same
    passes; those of (b) are groups of at most ``max(sizes)`` rows, each fitted in a task. Test rows are read once
    for all of them. A column without spread in a sample is zero. ``gamma`` defaults to 1 / columns, as columns have unit variance.
    """
    gamma = gamma or 1.0 / len(features)
    every = np.arange(len(features))
    if train_on_sample:
        def fit(group: pa.Table) -> pa.Table:
            x = np.stack([group[f].to_numpy().astype(float) for f in features], 1)
            order = np.lexsort(x.T)
            x, y = x[order], group["label"].to_numpy()[order]
            mean, scale = x.mean(0), x.std(0)
            shuffled = x[np.random.default_rng(seed).permutation(len(x))]
            m = margins.kernel_map(kernel, every, gamma, degree, shuffled, n_components, error_bound, mean, scale)
            model = MarginModel(list(features), m, margins.fit_here(m(x), y, c, max_iter))
            return pa.table({"size": group["size"][:1], "iteration": group["iteration"][:1], "model": pa.array([margins.dumps(model)], pa.binary())})

        kinds = f"size {samples.schema['size'].dataType.simpleString()}, iteration {samples.schema['iteration'].dataType.simpleString()}, model binary"
        wanted = samples.select("size", "iteration", F.col("label").cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in features])
        found = wanted.groupBy("size", "iteration").applyInArrow(fit, kinds).collect()
        models = {(r["size"], r["iteration"]): margins.loads(bytes(r["model"])) for r in found}
    else:
        stats = samples.groupBy("size", "iteration").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).collect()
        rows = margins.prepare(train_rows, features)
        margins.counts_of(rows)
        marks = margins.sample_rows(rows, 2 * n_components, seed)[None] if kernel != "linear" else np.zeros((0, len(features)))
        jobs = []
        for r in stats:
            mean, scale = (np.array([r[f"{a}_{f}"] for f in features], float) for a in "ms")
            jobs.append(margins.Job((r["size"], r["iteration"]), margins.kernel_map(kernel, every, gamma, degree, marks, n_components, error_bound, mean, scale), c))
        if kernel == "linear":
            # Scalings differ in their ridge only: the first fit, in the scaling of each other one, is a start next to its optimum.
            margins.minimise(rows, jobs[:1], max_iter)
            scale = jobs[0].map.scale if jobs else None
            weights = np.divide(jobs[0].params[:-1], scale, out=np.zeros(len(features)), where=scale > 0) if jobs else None
            for j in jobs[1:]:
                j.start = np.append(weights * j.map.scale, jobs[0].params[-1] + np.where(j.map.scale > 0, weights, 0) @ (j.map.mean - jobs[0].map.mean))
            margins.minimise(rows, jobs[1:], max_iter)
        else:
            margins.minimise(rows, jobs, max_iter)
        models = {j.name: MarginModel(list(features), j.map, j.params) for j in jobs}
    tests = margins.prepare(test_rows, features)
    cells = margins.count_cells(tests, {name: (None, None, m) for name, m in models.items()})
    names = samples.sparkSession.createDataFrame([(k, size, i) for k, (size, i) in enumerate(models)], "model int, size int, iteration int")
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return cells.join(F.broadcast(names), "model").select(
        "size", "iteration", share(tp + tn, tn + fp + fn + tp).alias("accuracy"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def pca(df: DataFrame, features: Sequence[str], k: int = 2) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """M4: scores ``pc1..pck`` of the standardised features, loadings (features by k) and variance ratios.

    The sign of a component is chosen so that its largest loading is positive. Components are those of the correlations, whose
    diagonal is exactly 1: where columns hardly correlate, the last digits of a variance would turn the components.
    """
    z = zscore_columns(df.withColumns({f"_z_{c}": F.col(c).cast("double") for c in features}), [f"_z_{c}" for c in features])
    v = VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="_v").transform(z)
    values, vectors = np.linalg.eigh(Correlation.corr(v, "_v").first()[0].toArray())
    load, ratio = vectors[:, ::-1][:, :k], values[::-1][:k] / values.sum()
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    scores = [sum((F.col(f"_z_{c}") * float(load[i, j]) for i, c in enumerate(features)), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(k)]
    return z.select(*df.columns, *scores), load, ratio


def feature_contributions(spark, features: Sequence[str], loadings: np.ndarray, component: int = 0, n: int = 10, decimals: int = 2) -> DataFrame:
    """Share of each feature in a component in percent, largest first."""
    part = np.abs(loadings[:, component])
    rows = [(f, float(x)) for f, x in zip(features, part / part.sum() * 100)]
    df = spark.createDataFrame(rows, "feature string, contribution double")
    return df.orderBy(F.col("contribution").desc(), "feature").limit(n).withColumn("contribution", F.round("contribution", decimals))


def chi2_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution with 2 or 3 degrees of freedom."""
    if dof == 2:
        return -2.0 * math.log1p(-p)
    if dof != 3:
        raise ValueError("dims must be 2 or 3")
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        cdf = math.erf(math.sqrt(mid / 2)) - math.sqrt(2 * mid / math.pi) * math.exp(-mid / 2)
        lo, hi = (mid, hi) if cdf < p else (lo, mid)
    return (lo + hi) / 2


def _distance(cols: Sequence[str], centre: np.ndarray, cov: np.ndarray) -> Column:
    inv = np.linalg.inv(cov)
    d = [F.col(c) - float(m) for c, m in zip(cols, centre)]
    return sum((d[i] * d[j] * float(inv[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))


def _centre_and_cov(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).first()
    cov = np.empty((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row[len(cols):]):
        cov[i, j] = cov[j, i] = v
    return np.array(row[:len(cols)], dtype=float), cov


SEARCH_POINTS = 1500  # points of the sample in which starts are compared


def _concentrated(x: np.ndarray, centre: np.ndarray, cov: np.ndarray, share: float, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean and covariance of the closest ``share`` of the points, some times over; the determinant first."""
    n = max(x.shape[1] + 1, math.ceil(share * len(x)))
    for _ in range(steps):
        off = x - centre
        near = x[np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable")[:n]]
        centre, cov = near.mean(0), np.cov(near.T, bias=True)
        if not np.linalg.det(cov) > 0:
            return math.inf, centre, cov
    return float(np.linalg.det(cov)), centre, cov


def region_starts(sample: np.ndarray, share: float, starts: int, kept: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``kept`` best of many random starts in a sample: mean and covariance of a few points each, concentrated twice."""
    rng, dims, found = np.random.default_rng(seed), sample.shape[1], {}
    for _ in range(starts):
        order = rng.permutation(len(sample))
        n = dims + 1
        while n <= len(sample) and not np.linalg.det(np.cov(sample[order[:n]].T, bias=True)) > 0:
            n += 1
        if n > len(sample):
            break
        few = sample[order[:n]]
        det, centre, cov = _concentrated(sample, few.mean(0), np.cov(few.T, bias=True), share, 2)
        if math.isfinite(det):
            found[round(math.log(det), 9), *np.round(centre, 9)] = (det, centre, cov)
    return [(c, v) for _, c, v in sorted(found.values(), key=lambda f: f[0])[:kept]]


def _concentrate_all(pts: DataFrame, cols: Sequence[str], states: list[tuple[np.ndarray, np.ndarray]], share: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """One concentration step of several states over all points: distances of all states side by side, one exact selection, one aggregate."""
    each = F.posexplode(F.array(*[_distance(cols, c, v) for c, v in states])).alias("_state", "_d")
    d = materialize(pts.select(*cols, each), "distances")
    cuts = percentiles(d, ["_state"], "_d", {"_cut": share})
    # One row a state.
    near = d.join(F.broadcast(cuts), "_state").filter(F.col("_d") <= F.col("_cut") * (1 + 1e-12))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = []
    for row in near.groupBy("_state").agg(*[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in pairs]).orderBy("_state").collect():
        cov = np.empty((len(cols), len(cols)))
        for (i, j), v in zip(pairs, row[1 + len(cols):]):
            cov[i, j] = cov[j, i] = v
        out.append((float(np.linalg.det(cov)), np.array(row[1:1 + len(cols)], dtype=float), cov))
    return out


def points_in_region(
    scores: DataFrame, dims: int = 2, confidence: float = 0.95, max_steps: int = 20, starts: int = 500, refined: int = 10, seed: int = 42
) -> DataFrame:
    """M5: points whose robust squared Mahalanobis distance is within the chi-square quantile.

    Centre and spread follow the minimum covariance determinant (Rousseeuw and Van Driessen 1999). Random starts are compared in a
    hash sample of ``SEARCH_POINTS`` points; the ``refined`` best and one from medians and MADs then take two concentration
    steps over all points together, and the best of them goes on until it settles. A step takes mean and
    covariance of the closest half: one exact selection and one aggregate. Then follow the correction for consistency and the reweighting.
    """
    cols = [f"pc{i + 1}" for i in range(dims)]
    pts = materialize(scores, "points")
    n = pts.count()
    if n <= dims:
        raise ValueError("too few points for a robust region")
    half = (n + dims + 1) // 2
    share = (half - 1) / (n - 1)
    centre, spread = [], []
    for c in cols:
        med = percentiles(pts, [], c, {"m": 0.5}).first()["m"]
        mad = percentiles(pts.select(F.abs(F.col(c) - med).alias("d")), [], "d", {"m": 0.5}).first()["m"]
        centre.append(med)
        spread.append((1.4826 * mad) ** 2 or 1e-12)
    keyed = pts.select(*cols).withColumn("_key", F.xxhash64(*cols))
    sample = np.array(sorted(tuple(r)[:dims] for r in take_random(keyed, [], seed, ["_key"], F.lit(SEARCH_POINTS)).collect()), dtype=float)
    states = [*region_starts(sample, half / n, starts, refined, seed), (np.array(centre), np.diag(spread))]
    for _ in range(2):
        states = [(c, v) for det, c, v in sorted(_concentrate_all(pts, cols, states, share), key=lambda s: s[0] if s[0] > 0 else math.inf) if det > 0]
        if not states:
            raise ValueError("more than half of the points lie on a line")
    centre, cov = states[0]
    last = math.inf
    for _ in range(max_steps):
        (det, new_centre, new_cov), = _concentrate_all(pts, cols, [(centre, cov)], share)
        if not det > 0 or last - det <= 1e-12 * abs(det):
            break
        centre, cov, last = new_centre, new_cov, det
    d = pts.withColumn("_d", _distance(cols, centre, cov))
    cov = cov * (percentiles(d, [], "_d", {"m": 0.5}).first()["m"] / chi2_quantile(0.5, dims))
    near = pts.filter(_distance(cols, centre, cov) < chi2_quantile(0.975, dims))
    centre, cov = _centre_and_cov(near, cols)
    return pts.filter(_distance(cols, centre, cov) <= chi2_quantile(confidence, dims))


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, max_iter: int = 300, tol: float = 1e-4, seed: int | None = None) -> tuple[DataFrame, DataFrame, float]:
    """M6: rows with ``cluster``, table of centroids, and the sum of squared distances."""
    v = VectorAssembler(inputCols=list(features), outputCol="_v")
    est = KMeans(k=k, maxIter=max_iter, tol=tol, featuresCol="_v", predictionCol="cluster")
    if seed is not None:
        est = est.setSeed(seed)
    x = v.transform(df)
    model = est.fit(x)
    centres = [(i, *[float(c) for c in m]) for i, m in enumerate(model.clusterCenters())]
    schema = "cluster int, " + ", ".join(f"`{f}` double" for f in features)
    return model.transform(x).drop("_v"), df.sparkSession.createDataFrame(centres, schema), float(model.summary.trainingCost)


def save_model(model: MarginModel, path: str) -> None:
    """One row with the model, as Parquet in any store Spark writes to."""
    spark = SparkSession.active()
    spark.createDataFrame([(",".join(model.features), model.map.kernel, model.kernel_error, margins.dumps(model))], "features string, kernel string, kernel_error double, model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(path: str) -> MarginModel:
    """Models are pickled NumPy arrays; load only files that you have written."""
    return margins.loads(bytes(SparkSession.active().read.parquet(path).first()["model"]))
