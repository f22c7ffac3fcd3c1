"""Models and multivariate analysis over the embedding signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.catalog import inputs as I
from epochwise.operators import splits as S
from epochwise.plans import clusters as C
from epochwise.plans import models as M
from epochwise.session import load, materialize, new_path

NAMES = [f"x{k}" for k in range(64)]
SWEEP = ["Alpha", "Beta", "Theta", "Delta", "spectral_skewness", "spectral_kurtosis", "shannon_entropy", "permutation_entropy"]
SIZES = [50, 100, 150, 200, 400, 600, 800, 1000, 1200, 1400, 1600, 1800]


def table(s, d):
    e = I.epoch_signals(s, d)
    return e.select("case_id", "start", "end", "label", *[F.element_at("eeg", i + 1).alias(n) for i, n in enumerate(NAMES)])


def folds(s, d):
    return materialize(S.cross_validation_splits(table(s, d), 3, None), "folds", ["fold", "role"])


def single(s, d):
    t = table(s, d)
    roles = S.find_case_split(S.case_counts(t), 0.2)
    return materialize(S.balanced_split(t.join(roles, "case_id"), 0.2), "single", ["role"])


def classifier(s, d):
    rows = single(s, d)
    model = M.train(rows.filter("role = 'train'"), NAMES)
    return M.predict(model, rows.filter("role = 'test'")).select("case_id", "start", "end", "label", "prediction", "score", "error")


def stored_model(s, d):
    rows = single(s, d)
    path = new_path(s, "model")
    M.save_model(M.train(rows.filter("role = 'train'"), NAMES, kernel="linear"), path)
    return M.predict(M.load_model(path), rows.filter("role = 'test'")).select("case_id", "start", "end", "label", "prediction", "score", "error")


def grid(s, d):
    t = materialize(table(s, d).join(S.case_folds(S.case_counts(table(s, d)), 2), "case_id"), "grid")
    res = M.grid_search(t, NAMES, "fold", 2, M.GRID)
    return s.createDataFrame([(r["kernel"], r["C"], r["gamma"], float(r["score"]), r["kernel_error"]) for r in res], "kernel string, C double, gamma double, score double, kernel_error double")


def combos(s, d):
    """The whole sweep: 255 runs over all folds."""
    f = folds(s, d).withColumnsRenamed(dict(zip(NAMES, SWEEP)))
    return M.sweep(f, M.feature_combinations(), kernel="linear")


def experiment(s, d):
    """All 12 sizes and 50 iterations, the sample as scale and as training set."""
    rows = single(s, d)
    tr, te = rows.filter("role = 'train'"), rows.filter("role = 'test'")
    picked = materialize(S.stratified_samples(tr, SIZES, 50), "picked")
    a = M.sampling_experiment(tr, te, picked, NAMES).withColumn("kind", F.lit("normalise"))
    return a.unionByName(M.sampling_experiment(tr, te, picked, NAMES, True).withColumn("kind", F.lit("train")))


def features2(s, d):
    return load(s, d, "lineitem").select("l_orderkey", F.col("l_quantity"), F.col("l_extendedprice"), "l_discount", "l_tax", F.col("l_suppkey").alias("case_id"))


def pca_ratio(s, d):
    _, _, ratio = M.pca(features2(s, d), ["l_quantity", "l_extendedprice"], 2)
    return s.createDataFrame([(i + 1, round(float(r), 6)) for i, r in enumerate(ratio)], "component int, ratio double")


def pca_scores(s, d):
    scores, _, _ = M.pca(features2(s, d), ["l_quantity", "l_extendedprice"], 2)
    return scores.select("l_orderkey", "case_id", "l_quantity", "l_extendedprice", F.round("pc1", 4).alias("pc1"))


def contributions(s, d):
    cols = ["l_quantity", "l_extendedprice"]
    _, loadings, _ = M.pca(features2(s, d), cols, 2)
    return M.feature_contributions(s, cols, loadings, 0)


def region(s, d):
    t = table(s, d)
    scores, _, _ = M.pca(t, NAMES, 2)
    return M.points_in_region(scores.filter("label = 1").select("case_id", "start", "end", "pc1", "pc2"), 2, 0.9)


def clusters(s, d):
    rows, _, _ = M.kmeans(table(s, d), NAMES, 3, 300, 1e-4, 42)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in NAMES])


def subset_clusters(s, d):
    """All epochs, those of either class, and the second class split by an outlier rule on the id."""
    awake, wrong = F.col("label") == 1, F.col("start") % 7 == 0
    subsets = {"all": F.lit(True), "faw": ~awake, "awake": awake, "correct_awake": awake & ~wrong, "wrong_awake": awake & wrong}
    rows, _, _ = C.kmeans_by(table(s, d), NAMES, subsets, 3)
    return rows.groupBy("subset", "cluster").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in NAMES])


QUERIES = {
    "m1_margin_classifier": (classifier, None),
    "m2_parameter_grid": (grid, None),
    "m3_fold_evaluation": (lambda s, d: M.evaluate_folds(folds(s, d), NAMES)[1], None),
    "m4_pca_variance_ratio": (
        pca_ratio, """WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
        SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio FROM c UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM c"""),
    "m4_pca_scores": (
        pca_scores, """WITH z AS (SELECT l_orderkey, l_suppkey AS case_id, l_quantity, l_extendedprice, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
          (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)
        SELECT l_orderkey, case_id, l_quantity, l_extendedprice, round((a + b) / sqrt(2), 4) AS pc1 FROM z"""),
    "g3_feature_contributions": (
        contributions, """SELECT feature, 50.0::DOUBLE AS contribution FROM (SELECT 'l_quantity' AS feature UNION ALL SELECT 'l_extendedprice') WHERE (SELECT count(*) FROM lineitem) > 1"""),
    "m5_confidence_region": (region, None),
    "m6_kmeans": (clusters, None),
    "m6_kmeans_by_subset": (subset_clusters, None),
    "m7_feature_subset_sweep": (combos, None),
    "l8_sampling_experiment": (experiment, None),
    "b6_stored_model": (stored_model, None),
}
