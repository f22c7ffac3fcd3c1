"""Errors and special values that are easy to pass over in silence."""

import math

import numpy as np
import pytest

from epochwise.operators import keyed, stats
from epochwise.operators.episodes import detect_episodes
from epochwise.operators.tracks import interpolate_extrapolate
from epochwise.plans import margins, models
from epochwise.session import shared_dir

KEYS = "case_id long, start double, end double"


def test_nan_mac_is_not_above_a_threshold(spark):
    rows = [(1, k, float(k), 90.0, math.nan, 0) for k in range(10)] + [(2, k, float(k), math.nan, 2.0, 0) for k in range(10)]
    t = spark.createDataFrame(rows, "case_id long, row_idx long, time double, bis double, mac double, chunk long")
    assert detect_episodes(t, [(70, 0.5)], [2], [0]).count() == 0


def test_nan_is_a_gap(spark):
    rows = [(1, k, float(k), v, 0) for k, v in enumerate([math.nan, 1.0, math.nan, 3.0, None])]
    t = spark.createDataFrame(rows, "case_id long, row_idx long, time double, mac double, chunk long")
    filled, failed = interpolate_extrapolate(t)
    assert [r["mac"] for r in filled.orderBy("time").collect()] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert failed.count() == 0


def test_feature_join(spark):
    a = spark.createDataFrame([(2, 0.0, 1.0, 5.0), (1, 0.0, 1.0, 7.0)], KEYS + ", x double")
    b = spark.createDataFrame([(1, 0.0, 1.0, 6.0), (2, 0.0, 1.0, 6.5)], KEYS + ", y double")
    with pytest.warns(UserWarning, match="left out"):
        got = keyed.combine_features({"a": a, "b": b, "c": None})
    assert [(r["case_id"], r["x"], r["y"]) for r in got.collect()] == [(1, 7.0, 6.0), (2, 5.0, 6.5)]
    z = keyed.combine_features({"a": a, "b": b}, normalize=True).collect()
    assert [(r["x"], r["y"]) for r in z] == [(1.0, -1.0), (-1.0, 1.0)]
    with pytest.raises(ValueError, match="no complete row"):
        keyed.combine_features({"a": a.filter("case_id = 1"), "b": b.filter("case_id = 2")})


def test_no_spectra_and_no_table(spark):
    with pytest.raises(ValueError, match="no spectra"):
        stats.mean_spectrum(spark.createDataFrame([], "set string, freq_hz double, psd double"))
    a = spark.createDataFrame([(1, 0.0, 1.0)], KEYS)
    assert keyed.compare_keys(a, None).first()["missing_from_b"] == 1
    assert keyed.missing_keys(None, a).first()["missing_from"] == "a"
    with pytest.raises(ValueError, match="both"):
        keyed.compare_keys(None, None)


def test_stage_folder_has_to_be_named_on_a_cluster():
    class Conf:
        def __init__(self, **values):
            self.values = {k.replace("_", "."): v for k, v in values.items()}

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    for master, folder in (("spark://host:7077", None), ("yarn", None), ("local-cluster[2,1,1024]", None), ("yarn", "hdfs://x/y"), ("local[4]", None)):
        conf = Conf(spark_master=master, **({"spark_checkpoint_dir": folder} if folder else {}))
        fake = type("Session", (), {"conf": conf})()
        if folder or master.startswith("local["):
            assert shared_dir(fake) == conf.get("spark.checkpoint.dir")
        else:
            with pytest.raises(ValueError, match="checkpoint"):
                shared_dir(fake)


def test_polynomial_kernel():
    """The inner product of the mapped features is ``(gamma x.y) ** degree``."""
    points = np.array([[0.5, -2.0, 1.5], [1.0, 3.0, -0.25]])
    for gamma, degree in ((0.1, 3), (2.0, 2)):
        x, y = margins.products(np.arange(3), gamma, degree)(points)
        assert x @ y == pytest.approx((gamma * (0.5 - 6.0 - 0.375)) ** degree)


def test_runs_of_the_sweep():
    runs = models.feature_combinations()
    assert len(runs) == 255 == len({r["run"] for r in runs})
    assert {r["run"] for r in models.feature_combinations(("bandpower", "spectral_skewness"), ("Alpha", "Beta"), "")} == {"bandA", "bandB", "bandAB", "skew", "bandA_skew", "bandB_skew", "bandAB_skew"}
