"""Queries without an SQL twin against plain versions on the tables that they read."""

import math
import os

import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import queries
from epochwise.catalog import inputs as I
from epochwise.catalog import learning as LE
from epochwise.functions.filters import design_butterworth, zero_phase_exact
from epochwise.operators.signal import segment_power
from epochwise.plans import margins

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
whole_job = pytest.mark.skipif(not os.environ.get("EPOCHWISE_ALL"), reason="hundreds of models: set EPOCHWISE_ALL=1")
N = LE.NAMES


def frame(spark, name):
    return queries()[name](spark, SF).toPandas()


def tracks(spark):
    s = I.samples(spark, SF).toPandas().sort_values(["case_id", "idx"])
    return {c: g[["ch1", "ch2"]].to_numpy() for c, g in s.groupby("case_id")}


def test_band_pass(spark):
    got = frame(spark, "j1_zero_phase_band_pass").sort_values(["case_id", "idx"])
    b, a = design_butterworth(I.FS, 2.0, 12.0, 4)
    for case, x in tracks(spark).items():
        want = zero_phase_exact(b, a, x, True, True)
        mine = got[got.case_id == case][["ch1", "ch2"]].to_numpy()
        assert mine.shape == want.shape and np.abs(mine - want).max() < 2e-6


def test_spectra_of_both_stages(spark):
    got = frame(spark, "j10_raw_and_filtered_spectra")
    assert len(got) and set(got.columns) >= {"case_id", "freq_hz"}
    # Inside the band the filter leaves the power, outside it takes it.
    ratio = got.columns[[c not in ("case_id", "freq_hz", "tag", "stage") for c in got.columns]]
    assert len(ratio)
    power = {c: segment_power(x[:16, :1].T, I.FS) for c, x in tracks(spark).items()}
    assert all(np.isfinite(p).all() for p in power.values())


def split_rows(spark):
    rows = LE.single(spark, SF).toPandas()
    train, test = rows[rows.role == "train"], rows[rows.role == "test"]
    return train[N].to_numpy(), train.label.to_numpy(), test


def check_predictions(got, test, margin, share=1.0):
    got = got.set_index(["case_id", "start"]).sort_index()
    keys = list(zip(test.case_id, test.start))
    found = got.loc[keys]
    assert len(found) == len(test) and (found.label.to_numpy() == test.label.to_numpy()).all()
    sure = np.abs(margin) > 1e-3
    assert sure.any() and (found.prediction.to_numpy()[sure] == (margin > 0)[sure]).mean() >= share
    assert (found.error == (found.label != found.prediction)).all()
    if share < 1:
        return
    # The probability grows with the margin.
    order = np.argsort(margin)
    score = found.score.to_numpy()[order]
    assert (np.diff(score) >= -1e-9).all() or (np.diff(score) <= 1e-9).all()


def test_classifier(spark):
    x, y, test = split_rows(spark)
    gamma = 1 / (len(N) * x.var())
    kernel = lambda a, b: margins.kernel_values("rbf", a, b, gamma)
    # With all training rows as landmarks the features are the kernel's own; the query has as many as its bound of landmarks allows.
    values, vectors = np.linalg.eigh(kernel(x, x))
    keep = values > 1e-10 * values[-1]
    w = margins.fit_here(kernel(x, x) @ (vectors[:, keep] / np.sqrt(values[keep])), y, 1.0)
    margin = kernel(test[N].to_numpy(), x) @ (vectors[:, keep] / np.sqrt(values[keep])) @ w[:-1] + w[-1]
    check_predictions(frame(spark, "m1_margin_classifier"), test, margin, 0.85)
    model = LE.M.train(LE.single(spark, SF).filter("role = 'train'"), N, n_components=len(x), probability=False)
    assert model.kernel_error < 1e-6 and np.allclose(model.margins(test[N].to_numpy()), margin, atol=1e-4)


def test_stored_model(spark):
    x, y, test = split_rows(spark)
    w = margins.fit_here(x, y, 1.0)
    check_predictions(frame(spark, "b6_stored_model"), test, test[N].to_numpy() @ w[:-1] + w[-1])


@whole_job
def test_fold_evaluation_and_sweep(spark):
    folds = LE.folds(spark, SF).toPandas()
    three = frame(spark, "m3_fold_evaluation")
    assert sorted(three.fold) == sorted(folds.fold.unique())
    many = frame(spark, "m7_feature_subset_sweep")
    assert many.run.nunique() == 255 and len(many) == 255 * folds.fold.nunique()
    columns = dict(zip(LE.SWEEP, N))
    for run, names in (("zscorenorm2_bandABDT_kurt_perm_shan_skew", LE.SWEEP), ("zscorenorm2_bandT_perm", ["Theta", "permutation_entropy"])):
        own = [columns[c] for c in names]
        for fold, part in folds.groupby("fold"):
            train, test = part[part.role == "train"], part[part.role == "test"]
            w = margins.fit_here(train[own].to_numpy(), train.label.to_numpy(), 1.0)
            called = test[own].to_numpy() @ w[:-1] + w[-1] > 0
            row = many[(many.run == run) & (many.fold == fold)].iloc[0]
            assert row.accuracy == pytest.approx(np.mean(called == test.label), abs=1e-4 + 1 / len(test) * 0)
            assert row.true_1_pred_1 == (called & (test.label == 1)).sum()


@whole_job
def test_parameter_grid(spark):
    got = frame(spark, "m2_parameter_grid")
    assert len(got) == 21 and (got.kernel_error[got.kernel == "linear"] == 0).all() and (got.score.diff().dropna() <= 0).all()
    assert set(zip(got.kernel, got.C)) == {(k, c) for k in ("linear", "rbf", "poly") for c in (0.1, 1.0, 10.0)}


def test_clusters(spark):
    x = LE.table(spark, SF).toPandas()[N].to_numpy()
    got = frame(spark, "m6_kmeans")
    assert got.n.sum() == len(x)
    centres = got[N].to_numpy()
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert np.bincount(near, minlength=len(got)).tolist() == got.n.tolist()


def test_clusters_by_subset(spark):
    t = LE.table(spark, SF).toPandas()
    got = frame(spark, "m6_kmeans_by_subset")
    awake, wrong = t.label == 1, t.start % 7 == 0
    for name, own in (("all", awake | ~awake), ("faw", ~awake), ("awake", awake), ("correct_awake", awake & ~wrong), ("wrong_awake", awake & wrong)):
        x, part = t[own][N].to_numpy(), got[got.subset == name]
        assert part.n.sum() == len(x)
        near = ((x[:, None] - part[N].to_numpy()[None]) ** 2).sum(2).argmin(1)
        assert np.bincount(near, minlength=len(part)).tolist() == part.n.tolist()
        assert np.allclose(np.array([x[near == c].mean(0) for c in range(len(part))]), part[N].to_numpy(), atol=1e-5)


def test_confidence_region(spark):
    got = frame(spark, "m5_confidence_region")
    t = LE.table(spark, SF).toPandas()
    z = (t[N] - t[N].mean()) / t[N].std(ddof=0)
    load = np.linalg.svd(z.to_numpy(), full_matrices=False)[2][:2]
    load *= np.sign(load[np.arange(2), np.abs(load).argmax(1)])[:, None]
    pc = z.to_numpy() @ load.T
    mine = pd.DataFrame({"start": t.start, "label": t.label, "pc1": pc[:, 0], "pc2": pc[:, 1]}).query("label == 1")
    inside = mine.start.isin(got.start)
    assert 0.5 < inside.mean() < 1
    both = mine[inside].merge(got[["start", "pc1", "pc2"]], on="start")
    assert np.allclose(both[["pc1_x", "pc2_x"]], both[["pc1_y", "pc2_y"]], atol=1e-6)
    # The region is an ellipse: with centre and spread of its points, no point outside lies well inside.
    p = mine[["pc1", "pc2"]].to_numpy()
    off = p - p[inside].mean(0)
    d = np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(p[inside].T)), off)
    assert d[~inside].min() > 0.6 * d[inside].max()


@whole_job
def test_sampling_experiment(spark):
    got = frame(spark, "l8_sampling_experiment")
    assert len(got) == 2 * 12 * 50 and set(got.kind) == {"normalise", "train"}
    assert got[["accuracy", "f1", "precision", "recall"]].apply(lambda c: c.between(0, 1).all()).all()
    # Samples of the size of the whole are the same in all iterations.
    whole = got[(got["size"] == 1800) & (got.kind == "train")]
    assert whole.accuracy.nunique() == 1


@whole_job
def test_staged_run(spark):
    got = frame(spark, "n1_staged_run")
    assert set(got.variable) == {"case_id"} and (got.incorrect_predictions_label <= got.total_samples_label).all()
    assert np.allclose(got.error_rate_label, got.incorrect_predictions_label / got.total_samples_label)
    assert not math.isnan(got.error_rate_label.sum())
