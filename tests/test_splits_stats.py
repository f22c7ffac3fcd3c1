"""Splits, statistics, metrics and models: invariants and brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwise.functions import pvalues as PV
from epochwise.operators import keyed as K
from epochwise.operators import reports as R
from epochwise.operators import splits as S
from epochwise.operators import stats as ST


def greedy(counts, target, tol, trials, seed):
    """The case search as a plain loop over cases in hash order."""
    best = None
    for trial in trials:
        order = sorted(counts, key=lambda c: (hashlib.md5(f"{seed}:{trial}:{c}".encode()).hexdigest(), c))
        ids, s = [], 0
        for c in order:
            if s + counts[c] > target:
                continue
            ids.append(c)
            s += counts[c]
            if abs(s - target) / target <= tol:
                break
        if best is None or target - s < best[0]:
            best = (target - s, ids)
        if best[0] / target <= tol:
            break
    return set(best[1])


@pytest.mark.parametrize("seed,sizes", [(1, (1, 9)), (2, (1, 400)), (3, (200, 900)), (4, (500, 501))])
def test_case_split_equals_the_loop(spark, seed, sizes):
    rng = random.Random(seed)
    counts = {i: rng.randint(*sizes) for i in range(60)}
    df = spark.createDataFrame(list(counts.items()), "case_id long, n long")
    total = sum(counts.values())
    got = S.find_case_split(df, 0.15, max_iter=20, seed=seed).collect()
    assert {r["case_id"] for r in got if r["role"] == "test"} == greedy(counts, int(0.15 * total), 0.05, range(20), seed)
    assert len(got) == 60


def test_case_split_needs_enough_rows(spark):
    df = spark.createDataFrame([(1, 10), (2, 10)], "case_id long, n long")
    with pytest.raises(ValueError):
        S.find_case_split(df, 0.9, used=df.filter("case_id = 1"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    data = []
    for case in range(40):
        # Case 0 holds about a third of all rows.
        for i in range(400 if case == 0 else rng.randint(5, 40)):
            data.append((case, float(i), float(i + 1), int(rng.random() < 0.3), rng.random()))
    return spark.createDataFrame(data, "case_id long, start double, end double, label int, x double").cache()


def test_disjoint_folds(rows):
    a, b = rows.filter("label = 1").drop("label"), rows.filter("label = 0").drop("label")
    out = S.custom_splits(a, b, 0.2, seed=5).toPandas()
    assert out.fold.nunique() >= 2
    seen = set()
    for _, f in out.groupby("fold"):
        test, tr = f[f.role == "test"], f[f.role == "train"]
        assert not set(test.case_id) & set(tr.case_id)
        assert not set(test.case_id) & seen
        seen |= set(test.case_id)
        assert len(test) / len(f) == pytest.approx(0.2, abs=0.02)


def test_cross_validation_covers_every_case(rows):
    f = S.case_folds(S.case_counts(rows), 7).toPandas()
    sizes = f.groupby("fold").size()
    assert len(f) == 40 and sizes.max() - sizes.min() <= 1
    out = S.cross_validation_splits(rows, 4, None).toPandas()
    for _, part in out.groupby(["fold", "role"]):
        assert (part.label == 1).sum() == (part.label == 0).sum()


def test_append_only_new_keys(rows):
    assert K.compare_keys(rows, rows.filter("case_id <> 3")).first().asDict()["b_in_a"] is True
    assert K.still_to_do(rows, rows).isEmpty()


def test_metrics_and_auc(spark):
    rng = random.Random(0)
    data = [(i % 2, int(rng.random() < 0.5), int(rng.random() < 0.5), round(rng.random(), 1)) for i in range(200)]
    data += [(2, 1, 1, 0.5), (2, 1, 0, 0.2)]
    df = spark.createDataFrame(data, "fold int, label int, prediction int, score double")
    got = {r["fold"]: r for r in R.fold_metrics(df, ["fold"], "score").collect()}
    for fold in (0, 1, 2):
        part = [d for d in data if d[0] == fold]
        tp = sum(lab and p for _, lab, p, _ in part)
        assert got[fold]["accuracy"] == pytest.approx(sum(d[1] == d[2] for d in part) / len(part), abs=1e-4)
        assert got[fold]["recall"] == pytest.approx(tp / sum(d[1] for d in part), abs=1e-4)
        pos, neg = [d[3] for d in part if d[1]], [d[3] for d in part if not d[1]]
        if neg:
            auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
            assert got[fold]["roc_auc"] == pytest.approx(auc, abs=1e-4)
        else:
            assert got[fold]["roc_auc"] is None


def test_outlier_threshold_types(spark):
    df = spark.createDataFrame([(1, 0.5, 9), (2, 0.1, 9)], "g int, error_rate double, incorrect_predictions long")
    assert [r["g"] for r in R.outlier_groups(df, 5, 0.4).collect()] == [1]
    with pytest.raises(ValueError):
        R.outlier_groups(df, 5, 1)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(3)
    rows = [("a", 1, float(v)) for v in rng.normal(0.8, 1, 150)] + [("a", 0, float(v)) for v in rng.normal(0, 1, 150)]
    rows += [("tied", i % 2, 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "freq_hz string, label int, psd double")
    one = {r["freq_hz"]: r for r in ST.auroc_bootstrap(df, ["freq_hz"], "psd", 500, rows_per_chunk=40).collect()}
    two = {r["freq_hz"]: r for r in ST.auroc_bootstrap(df.repartition(5), ["freq_hz"], "psd", 500).collect()}
    pos, neg = [r[2] for r in rows if r[:2] == ("a", 1)], [r[2] for r in rows if r[:2] == ("a", 0)]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert one["a"]["auroc"] == pytest.approx(auc) and one["tied"]["auroc"] == 0.5
    # Standard error of Hanley and McNeil 1982, normal interval.
    q1, q2 = auc / (2 - auc), 2 * auc**2 / (1 + auc)
    se = math.sqrt((auc * (1 - auc) + 149 * (q1 - auc**2) + 149 * (q2 - auc**2)) / 150**2)
    assert one["a"]["ci_low"] == pytest.approx(auc - 1.96 * se, abs=0.02)
    assert one["a"]["ci_high"] == pytest.approx(auc + 1.96 * se, abs=0.02)
    assert one["a"]["ci_low"] == pytest.approx(two["a"]["ci_low"], abs=1e-12)
    assert one["a"]["significant"] and not one["tied"]["significant"]


def test_p_values():
    # Tables of Student's t: 12.706 (1), 2.228 (10), 1.984 (100) at 5 percent.
    for dof, t in ((1, 12.7062), (10, 2.22814), (100, 1.98397)):
        assert PV.student_two_sided(t, dof) == pytest.approx(0.05, abs=1e-5)
    assert PV.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    for a, b, c, d in itertools.product((0, 1, 3, 8), (2, 5), (1, 6), (4, 9)):
        n1, n2, k = a + b, c + d, a + c
        pm = {x: math.comb(n1, x) * math.comb(n2, k - x) / math.comb(n1 + n2, k) for x in range(max(0, k - n2), min(n1, k) + 1)}
        want = sum(p for p in pm.values() if p <= pm[a] * (1 + 1e-7))
        assert PV.fisher_two_sided(a, b, c, d) == pytest.approx(want)


def test_rank_sum_against_permutations(spark):
    x, y = [1.0, 2.0, 2.0, 5.0, 7.0, 9.0, 11.0, 12.0], [3.0, 2.0, 8.0, 14.0, 15.0, 16.0, 20.0]
    df = spark.createDataFrame([(1, 1, v) for v in x] + [(1, 0, v) for v in y], "g int, label int, v double")
    r = ST.rank_sum(df, ["g"], "v").first()
    vals = sorted(x + y)
    rank = {v: np.mean([i + 1 for i, u in enumerate(vals) if u == v]) for v in vals}
    assert r["rank_sum"] == sum(rank[v] for v in x)
    ranks = [rank[v] for v in x + y]
    mean = np.mean(ranks) * len(x)
    hits = [abs(sum(c) - mean) >= abs(r["rank_sum"] - mean) - 1e-9 for c in itertools.combinations(ranks, len(x))]
    assert r["p_value"] == pytest.approx(np.mean(hits), abs=0.02)


def test_models(spark, tmp_path):
    from epochwise.plans import models as M

    rng = np.random.default_rng(4)
    pts = rng.normal(size=(300, 2))
    lab = (np.hypot(*pts.T) < 1.1).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(pts, lab))], "i int, a double, b double, label int").cache()
    model = M.train(df, ["a", "b"], c=10, n_components=64, max_iter=20)
    out = M.predict(model, df)
    err = out.agg(F.avg("error")).first()[0]
    assert err < 0.12  # a disc: no straight line does better than about 0.4
    M.save_model(model, str(tmp_path / "m"))
    again = M.predict(M.load_model(str(tmp_path / "m")), df)
    assert out.select("i", "prediction").exceptAll(again.select("i", "prediction")).isEmpty()
    runs = M.feature_combinations()
    assert len(runs) == 255 and len({r["run"] for r in runs}) == 255
    assert "zscorenorm2_bandAT_skew" in {r["run"] for r in runs}


def test_robust_region_ignores_outliers(spark):
    from epochwise.plans import models as M

    rng = np.random.default_rng(6)
    good = rng.normal(size=(400, 2)) @ np.array([[2.0, 0.3], [0.0, 0.5]])
    bad = rng.normal(size=(60, 2)) * 0.2 + [30, 30]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.vstack((good, bad)))], "i int, pc1 double, pc2 double")
    inside = {r["i"] for r in M.points_in_region(df, 2, 0.95).collect()}
    assert not inside & set(range(400, 460))
    assert 0.88 < len(inside) / 400 < 0.99
    assert M.chi2_quantile(0.95, 2) == pytest.approx(5.991465, abs=1e-5)
    assert M.chi2_quantile(0.95, 3) == pytest.approx(7.814728, abs=1e-5)


def test_run_names():
    from epochwise.params import EpisodeParams, parse_codes

    p = EpisodeParams(70, 0.8, 20, 5, True, 10, 0.25)
    assert p.result_code() == "result_70_080_20_5" and p.window_code() == "Summary_Merged_Episodes_10_025"
    assert EpisodeParams().window_code() == "Summary_Episodes_20_000"
    assert parse_codes(p.result_code(), p.window_code()) == p
    with pytest.raises(ValueError):
        parse_codes("result_70", "x")


def test_steps_keep_their_order():
    from epochwise.plans.runs import run_steps

    seen = []
    steps = {n: (lambda s, n=n: seen.append(n)) for n in ("analyze", "filter", "combine")}
    run_steps(steps, ["analyze", "filter"])
    assert seen == ["filter", "analyze"]
    run_steps(steps)
    assert seen[2:] == ["filter", "combine", "analyze"]
    with pytest.raises(ValueError):
        run_steps(steps, ["nope"])
