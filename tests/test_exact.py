"""Exact resampling and rank tests, robust regions with many starts, k-means of several subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwise.functions.pvalues import rank_sum_two_sided
from epochwise.operators import stats as ST
from epochwise.plans import clusters
from epochwise.plans import models as M


def test_draws_are_one_multinomial_however_they_are_cut():
    n, replicates = 1000, 300
    whole = ST.draws_between(n, np.arange(n + 1), replicates, 5, 1)
    assert (whole.sum(0) == n).all() and whole.min() == 0
    assert whole.var() == pytest.approx(1 - 1 / n, abs=0.02)
    for cuts in ([0, 3, 3, 64, 65, 500, 1000], [0, 1000], [137, 138, 700], [999, 1000], [0, 0, 0, 1]):
        part = ST.draws_between(n, np.array(cuts), replicates, 5, 1)
        assert all((row == whole[a:b].sum(0)).all() for row, a, b in zip(part, cuts, cuts[1:]))
    assert not (ST.draws_between(n, np.arange(n + 1), replicates, 6, 1) == whole).all()
    assert ST.draws_between(0, np.array([0, 0]), 3, 1, 1).tolist() == [[0, 0, 0]]


def test_bootstrap_covers_the_truth(spark):
    """Of many samples the intervals of about 95 % hold the true area."""
    rng = np.random.default_rng(7)
    rows = [(g, k % 2, float(v)) for g in range(60) for k, v in enumerate(rng.normal(size=80) + 0.8 * (np.arange(80) % 2))]
    got = ST.auroc_bootstrap(spark.createDataFrame(rows, "g int, label int, v double"), ["g"], "v", 400).collect()
    truth = 0.5 * (1 + math.erf(0.8 / 2))
    assert len(got) == 60 and sum(r["ci_low"] <= truth <= r["ci_high"] for r in got) >= 52


def test_rank_sums_equal_enumeration():
    rng = np.random.default_rng(0)
    for n1, n0, tied in itertools.product(range(1, 12), range(1, 12), (False, True)):
        if n1 + n0 > 12:
            continue
        v = rng.integers(0, 5, n1 + n0) if tied else rng.permutation(n1 + n0)
        ordered = sorted(v.tolist())
        rank = {x: np.mean([i + 1 for i, u in enumerate(ordered) if u == x]) for x in ordered}
        ranks = [rank[x] for x in v.tolist()]
        w = sum(ranks[:n1])
        sums = [sum(c) for c in itertools.combinations(ranks, n1)]
        want = min(1.0, 2 * min(sum(s <= w + 1e-9 for s in sums), sum(s >= w - 1e-9 for s in sums)) / len(sums))
        sizes = [ordered.count(x) for x in sorted(set(ordered))]
        assert rank_sum_two_sided(n1, n0, w, sizes) == pytest.approx(want, abs=1e-12)
        if not tied:
            assert rank_sum_two_sided(n1, n0, w) == pytest.approx(want, abs=1e-12)


def test_small_sets_take_the_exact_test(spark):
    rows = [("small", 1, 1.0), ("small", 1, 2.0), ("small", 0, 3.0), ("small", 0, 4.0), ("small", 0, 4.0)]
    rows += [("large", k % 2, float(k * k % 97) + k / 1000) for k in range(60)] + [("one", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, label int, v double")
    exact = {r["g"]: r for r in ST.rank_sum(df, ["g"], "v").collect()}
    never = {r["g"]: r for r in ST.rank_sum(df, ["g"], "v", "never").collect()}
    assert exact["small"]["p_value"] == pytest.approx(2 / 10) and never["small"]["p_value"] != pytest.approx(0.2, abs=1e-3)
    assert exact["large"]["p_value"] == never["large"]["p_value"]
    assert exact["one"]["p_value"] == never["one"]["p_value"]
    untied = {r["g"]: r for r in ST.rank_sum(df.filter("v <> 4"), ["g"], "v", "untied").collect()}
    assert untied["small"]["p_value"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        ST.rank_sum(df, ["g"], "v", "always")


def test_region_finds_the_core_where_one_start_fails(spark):
    rng = np.random.default_rng(3)
    # Four of ten points in one tight, distant cluster: medians and MADs lie between the groups.
    good = rng.normal(size=(300, 2)) * [1.0, 0.7]
    bad = rng.normal(size=(200, 2)) * [0.9, 0.9] + [6, 6]
    pts = np.vstack((good, bad))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "i int, pc1 double, pc2 double")
    inside = {r["i"] for r in M.points_in_region(df, 2, 0.95).collect()}
    assert len(inside & set(range(300, 500))) == 0 and len(inside) > 0.85 * 300
    half = 251 / 500
    best = M.region_starts(pts, half, 500, 10, 42)
    assert len(best) == 10
    dets = [M._concentrated(pts, c, v, half, 20)[0] for c, v in best]
    median = np.median(pts, 0)
    mad = np.median(np.abs(pts - median), 0)
    single = M._concentrated(pts, median, np.diag((1.4826 * mad) ** 2), half, 50)[0]
    assert min(dets) <= single
    # A start inside the wrong group stays there: why there are many.
    wrong = M._concentrated(pts, np.array([5.0, 5.0]), np.eye(2) * 4, half, 50)[0]
    assert wrong > 1.2 * min(dets)


def test_clusters_of_subsets_equal_separate_runs(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [5, 5, 0], [0, 8, 8]])
    x = np.vstack([rng.normal(size=(60, 3)) + c for c in centres])
    rows = [(k, int(k % 3 == 0), *map(float, v)) for k, v in enumerate(x)] + [(900, 1, None, 1.0, 1.0), *[(1000 + k, 0, 1.0, 1.0, 1.0) for k in range(40)]]
    df = spark.createDataFrame(rows, "i int, label int, a double, b double, c double")
    awake, wrong = F.col("label") == 1, F.col("i") % 2 == 0
    subsets = {"all": F.lit(True), "faw": ~awake, "awake": awake, "correct_awake": awake & ~wrong, "wrong_awake": awake & wrong, "none": F.lit(False)}
    rows_all, table, cost = clusters.kmeans_by(df, ["a", "b", "c"], subsets, 3, seed=7)
    got = {(r["subset"], r["cluster"]): (r["a"], r["b"], r["c"]) for r in table.collect()}
    assert {n for n, _ in got} == set(subsets) - {"none"} and cost["none"] == 0
    members = {(r["subset"], r["i"]): r["cluster"] for r in rows_all.collect()}
    for name, cond in subsets.items():
        if name == "none":
            continue
        alone, one_table, one_cost = clusters.kmeans_by(df.filter(cond), ["a", "b", "c"], {name: F.lit(True)}, 3, seed=7)
        for r in one_table.collect():
            assert got[name, r["cluster"]] == pytest.approx((r["a"], r["b"], r["c"]), abs=1e-9)
        assert cost[name] == pytest.approx(one_cost[name])
        own = {(name, r["i"]): r["cluster"] for r in alone.collect()}
        assert own == {k: v for k, v in members.items() if k[0] == name}
    # Every row is with its nearest centroid, and every centroid is the mean of its rows.
    known = [r for r in rows if r[2] is not None]
    for name, chosen in (("all", known), ("awake", [r for r in known if r[1] == 1])):
        near = {}
        for r in chosen:
            far = {c: math.dist(r[2:], got[name, c]) for n, c in got if n == name}
            assert far[members[name, r[0]]] <= min(far.values()) + 1e-9
            near.setdefault(members[name, r[0]], []).append(r[2:])
        for c, p in near.items():
            assert np.mean(p, 0) == pytest.approx(got[name, c], abs=1e-3)


def test_wins_by_stretches_equal_wins_by_values():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50):
        n1, n0 = rng.integers(0, 3, n), rng.integers(0, 3, n)
        n1[0] += n1[0] + n0[0] == 0
        s1, s0, own = ST.win_stretches(n1, n0)
        assert (s1 * (np.cumsum(s0) - own * s0)).sum() == (n1 * (np.cumsum(n0) - 0.5 * n0)).sum()
        assert s1.sum() == n1.sum() and s0.sum() == n0.sum()
    # All of the second set below all of the first is one stretch.
    assert [x.tolist() for x in ST.win_stretches(np.array([0, 0, 2, 1]), np.array([1, 4, 0, 0]))] == [[3], [5], [0.0]]


def test_bootstrap_chains_a_bounded_number_of_ranges(spark, monkeypatch):
    """Not one row of 3 numbers a replicate for every few values: 1,000 of them failed by time and by memory at 1 GB."""
    seen = []
    bounded = ST.bounded_chunks
    monkeypatch.setattr(ST, "bounded_chunks", lambda df, by, v, rows: seen.append(rows) or bounded(df, by, v, rows))
    monkeypatch.setattr(ST, "RANGES", 8)
    df = spark.range(4000).selectExpr("id % 2 AS g", "cast(id div 2 % 2 as int) AS label", "cast(hash(id) as double) AS v")
    many = {r["g"]: r for r in ST.auroc_bootstrap(df, ["g"], "v", 100, rows_per_chunk=20).collect()}
    monkeypatch.setattr(ST, "RANGES", 1)
    one = {r["g"]: r for r in ST.auroc_bootstrap(df, ["g"], "v", 100, rows_per_chunk=20).collect()}
    assert seen == [500, 4000] and many == one


def test_draws_leave_no_memory_behind():
    """Without the collector of cycles: their arrays added up to 3 GB a worker."""
    import gc
    import tracemalloc

    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(5):
            ST.draws_between(1000, np.arange(0, 1001, 10), 2000, 5, 1)
        assert tracemalloc.get_traced_memory()[0] < 1_000_000
    finally:
        tracemalloc.stop()
        gc.enable()


def test_components_of_hardly_correlated_columns_stay_in_place(spark):
    """A covariance whose diagonal is 1 only to the last digits turns them, here by more than 1e-9."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 2)) * [1, 1e4] + [25, 5e4]
    x[:, 1] -= (x[:, 1] - x[:, 1].mean()) @ (x[:, 0] - x[:, 0].mean()) / ((x[:, 0] - x[:, 0].mean()) ** 2).sum() * (x[:, 0] - x[:, 0].mean())
    x[:, 1] += 1e-5 * 1e4 * (x[:, 0] - x[:, 0].mean())
    _, load, ratio = M.pca(spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double"), ["a", "b"], 2)
    assert np.abs(load) == pytest.approx(np.full((2, 2), 0.5**0.5), abs=1e-15) and ratio.sum() == pytest.approx(1)
