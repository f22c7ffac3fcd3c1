"""Many margin models in one pass against single fits and plain optimisation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwise.operators import splits as S
from epochwise.plans import margins
from epochwise.plans import models as M

NAMES = ["a", "b", "c", "d"]


def rows_of(n=240, seed=1, folds=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + 0.7 * x[:, 1] * x[:, 1] - 0.6 + 0.5 * rng.normal(size=n) > 0).astype(int)
    return [(k, k // 10, float(k), int(k % folds), "test" if k % 5 == 0 else "train", int(v), *map(float, r)) for k, (v, r) in enumerate(zip(y, x))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "case_id long, start long, end double, fold int, role string, label int, a double, b double, c double, d double")


def objective(phi, y, w, c):
    z = np.where(y == 1, 1.0, -1.0) * (phi @ w[:-1] + w[-1])
    return 0.5 * (w[:-1] ** 2).sum() + c * margins.CORNER * np.logaddexp(0, (1 - z) / margins.CORNER).sum(), 0.5 * (w[:-1] ** 2).sum() + c * np.maximum(0, 1 - z).sum()


def test_fit_is_the_optimum_and_near_the_hinge():
    rows = rows_of()
    x, y = np.array([r[6:] for r in rows]), np.array([r[5] for r in rows])
    w = margins.fit_here(x, y, 0.5)
    best, hinge = objective(x, y, w, 0.5)
    assert 0 <= best - hinge <= 0.5 * len(y) * margins.CORNER * math.log(2)
    for k, e in itertools.product(range(5), (-1e-3, 1e-3)):
        assert objective(x, y, w + e * np.eye(5)[k], 0.5)[0] > best
    gradient = margins.margin_sums(x, np.where(y == 1, 1.0, -1.0), w, 0.5)[1:6] + np.append(w[:-1], 0)
    assert np.abs(gradient).max() < 1e-4


def test_all_runs_of_a_sweep_equal_single_fits(spark):
    df = frame(spark, rows_of())
    wide = margins.prepare(df.filter("role = 'train'"), NAMES, "fold")
    subsets = [list(c) for n in range(1, 5) for c in itertools.combinations(NAMES, n)]
    wanted = [margins.Wanted((tuple(c), f, k), c, 0.7, k, fold=f) for c in subsets for f in ("0", "1", "2") for k in ("linear", "poly")]
    many = margins.fit_many(wide, NAMES, wanted)
    passes = next(iter(many.values())).passes
    assert len(many) == 90 and passes <= 60
    for columns, fold, kernel in ((("a",), "1", "linear"), (("a", "c", "d"), "2", "linear"), (("b", "c"), "0", "poly"), (tuple(NAMES), "1", "linear")):
        one = M.train(df.filter(f"role = 'train' AND fold = {fold}").select("label", *columns), list(columns), 0.7, kernel)
        # The parts of the margins are dealt by a hash of the features at hand, so only the model itself is the same.
        assert np.allclose(many[columns, fold, kernel].params, one.params, atol=1e-6)


def test_sweep_metrics_equal_single_evaluations(spark):
    df = frame(spark, rows_of(150, folds=2))
    runs = [{"run": "ab", "columns": ["a", "b"]}, {"run": "abcd", "columns": NAMES}]
    got = {(r["run"], r["fold"]): r for r in M.sweep(df, runs, kernel="linear").collect()}
    assert set(got) == {("ab", 0), ("ab", 1), ("abcd", 0), ("abcd", 1)}
    want = {r["fold"]: r for r in M.evaluate_folds(df, NAMES, kernel="linear")[1].collect()}
    for fold in (0, 1):
        assert all(got["abcd", fold][c] == want[fold][c] for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "true_0_pred_0"))


def test_kernel_error_is_measured_and_bounded(spark):
    df = frame(spark, rows_of(600))
    x = np.array([r[6:] for r in rows_of(600)])
    coarse = margins.kernel_map("rbf", np.arange(4), 0.25, 3, x, 64, 1e-9)
    fine = margins.kernel_map("rbf", np.arange(4), 0.25, 3, x, 512, 1e-2)
    exact = margins.kernel_map("rbf", np.arange(4), 0.25, 3, x, 600, 0.0)
    assert coarse.error > fine.error > 0 and fine.error <= 1e-2 and exact.error < 1e-4
    model = M.train(df, NAMES, probability=False)
    want = margins.kernel_values("rbf", x, x, model.map.gamma)
    phi = model.map(x)
    assert model.kernel_error <= 0.05
    assert np.sqrt(np.mean((phi @ phi.T - want) ** 2) / np.mean(want**2)) <= 0.06
    pooled = x.var()
    assert model.map.gamma == pytest.approx(1 / (4 * pooled))


def test_probability_comes_from_unseen_rows(spark):
    rng = np.random.default_rng(8)
    # Few rows and many columns without meaning: training margins are far too sure.
    n, names = 80, [f"f{k}" for k in range(30)]
    x, hidden = rng.normal(size=(n + 1500, 30)), rng.normal(size=n + 1500)
    y = (x[:, 0] + hidden > 0).astype(int)
    df = spark.createDataFrame([(int(v), *map(float, r)) for v, r in zip(y[:n], x[:n])], "label int, " + ", ".join(f"{f} double" for f in names))
    model = M.train(df, names, kernel="linear")
    rows = margins.prepare(df, names)
    jobs = [margins.Job("same", model.map, 1.0, params=model.params)] * margins.PARTS
    n1 = int(y[:n].sum())
    naive = margins.Sigmoid("naive", jobs, None, (1 / (n - n1 + 2), (n1 + 1) / (n1 + 2)))
    margins.minimise(rows, [naive])

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * model.margins(x[n:]) + b)))
        return -np.mean(np.where(y[n:] == 1, np.log(p), np.log(1 - p)))

    assert loss(*model.sigmoid) < loss(*naive.params)


def test_grid_equals_fold_by_fold(spark):
    df = frame(spark, rows_of(200, folds=2))
    grid = {"C": (0.1, 1.0), "gamma": (0.3,), "kernel": ("linear", "rbf", "poly")}
    found = M.grid_search(df, NAMES, "fold", 2, grid)
    assert len(found) == 6 and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    for r in (found[0], found[-1]):
        scores = []
        for fold in (0, 1):
            model = M.train(df.filter(f"fold <> {fold}"), NAMES, r["C"], r["kernel"], r["gamma"], probability=False)
            scores.append(1 - M.predict(model, df.filter(f"fold = {fold}")).agg(F.avg("error")).first()[0])
        assert r["score"] == pytest.approx(np.mean(scores), abs=1e-12)
    with pytest.raises(ValueError):
        M.grid_search(df, NAMES, "fold", 2, grid, metric="mood")


def test_sampling_experiment_equals_single_fits(spark):
    df = frame(spark, rows_of(200))
    tr, te = df.filter("role = 'train'").drop("fold", "role"), df.filter("role = 'test'").drop("fold", "role")
    picked = S.stratified_samples(tr, [20, 60], 3).cache()
    rows = [r.asDict() for r in picked.collect()]
    xt, yt = (np.array([[r[c] for c in NAMES] for r in te.collect()]), np.array([r["label"] for r in te.collect()]))
    xa, ya = (np.array([[r[c] for c in NAMES] for r in tr.collect()]), np.array([r["label"] for r in tr.collect()]))
    for whole in (False, True):
        got = {(r["size"], r["iteration"]): r for r in M.sampling_experiment(tr, te, picked, NAMES, whole).collect()}
        assert len(got) == 6
        for (size, iteration), r in got.items():
            own = [x for x in rows if x["size"] == size and x["iteration"] == iteration]
            x, y = np.array([[v[c] for c in NAMES] for v in own]), np.array([v["label"] for v in own])
            mean, std = x.mean(0), x.std(0)
            w = margins.fit_here((x - mean) / std, y, 1.0) if whole else margins.fit_here((xa - mean) / std, ya, 1.0)
            called = (xt - mean) / std @ w[:-1] + w[-1] > 0
            assert r["accuracy"] == pytest.approx(np.mean(called == yt), abs=1e-4)
            assert r["recall"] == pytest.approx(called[yt == 1].mean(), abs=1e-4)


def test_rbf_experiment_and_missing_values(spark):
    df = frame(spark, rows_of(120))
    tr, te = df.filter("role = 'train'").drop("fold", "role"), df.filter("role = 'test'").drop("fold", "role")
    picked = S.stratified_samples(tr, [30], 2)
    for whole in (False, True):
        got = M.sampling_experiment(tr, te, picked, NAMES, whole, kernel="rbf", n_components=32).collect()
        assert len(got) == 2 and all(0 <= r["accuracy"] <= 1 for r in got)
    with pytest.raises(ValueError, match="missing"):
        M.train(df.withColumn("b", F.when(F.col("case_id") > 3, F.col("b"))), NAMES, kernel="linear")
    model = M.train(df, NAMES, kernel="linear")
    out = M.predict(model, df.withColumn("b", F.when(F.col("case_id") > 3, F.col("b")))).filter("case_id <= 3")
    assert out.count() == 4 and out.filter("prediction IS NOT NULL OR score IS NOT NULL").isEmpty()


def test_models_on_plain_columns_share_their_sums():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)) * [1, 10, 0.1, 1, 1] + [0, 50, 3, 0, -2]
    y, part = np.where(rng.random(500) < 0.5, 1.0, -1.0), rng.integers(0, margins.PARTS, 500)
    scaled = [margins.FeatureMap("linear", np.array(c), mean=x[:50, c].mean(0), scale=s * x[:50, c].std(0)) for c, s in (([0, 1, 2], 1.0), ([4, 1], np.array([1.0, 0.0])), ([3], 2.0))]
    maps = [*scaled, margins.FeatureMap("linear", np.array([2, 0]))]
    jobs = [margins.Job(k, m, 0.5 + k) for k, m in enumerate(maps)]
    shared = margins.Shared.of(list(enumerate(jobs)))
    params = [rng.normal(size=m.width + 1) for m in maps]
    corner = np.array([1.0, 0.3, 0.1, 0.1])
    together = np.stack([t @ p for t, p in zip(shared.turns, params)], 1)
    got = margins.shared_sums(shared.wide(x), y, together, np.array([j.cost for j in jobs]), corner)
    for k, j in enumerate(jobs):
        want = margins.margin_sums(j.map(x), y, params[k], j.cost, corner[k])
        assert np.allclose(shared.own(k, got[k]), want, rtol=1e-9, atol=1e-9 * np.abs(want).max())
    got = margins.shared_sigmoid_sums(x, np.maximum(y, 0), (w := rng.normal(size=(5, 2))), np.array([[0.1, 0.2], [0.9, 0.7]]), np.array([[1.0, 0.3], [0.2, -1.0]]))
    for k, (low, high, a, b) in enumerate(((0.1, 0.9, 1.0, 0.2), (0.2, 0.7, 0.3, -1.0))):
        assert np.allclose(got[k], margins.sigmoid_sums((x @ w)[:, k], np.where(y == 1, high, low), np.array([a, b])))


def test_rows_at_hand_may_all_be_of_the_part_that_is_left_out(spark):
    """The last rows of a fold in a batch are often few, and then of one part; a batch of two rows shows it at any size."""
    rng = np.random.default_rng(8)
    empty = margins.shared_sums(np.zeros((0, 5)), np.zeros(0), rng.normal(size=(5, 3)), np.ones(3), np.ones(3))
    assert empty.shape == (3, 1 + 5 + 15) and not empty.any()
    rows = margins.prepare(frame(spark, rows_of(90, 4)).filter("role = 'train'"), NAMES, "fold")
    wanted = [margins.Wanted((tuple(c), f), c, 0.7, "linear", fold=f) for c in (["a"], ["b", "d"], NAMES) for f in ("0", "1", "2")]
    whole = margins.fit_many(rows, NAMES, wanted)
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "2")
    try:
        few = margins.fit_many(rows, NAMES, wanted)
    finally:
        spark.conf.set(key, old)
    for name, model in whole.items():
        assert np.allclose(few[name].params, model.params, atol=1e-6) and np.allclose(few[name].sigmoid, model.sigmoid, atol=1e-6)


def test_a_start_nearby_saves_passes_and_not_accuracy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    label = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, label)], "a double, b double, c double, d double, label int")
    rows = margins.prepare(df, list("abcd"))
    whole = margins.Job("whole", margins.FeatureMap("linear", np.arange(4)), 1.0)
    first = margins.minimise(rows, [whole])
    cold = [margins.Job(p, whole.map, 1.0, part=p) for p in range(margins.PARTS)]
    warm = [margins.Job(p, whole.map, 1.0, part=p, start=whole.params) for p in range(margins.PARTS)]
    assert margins.minimise(rows, warm) <= margins.minimise(rows, cold) // 2 and first > 4
    assert all(np.allclose(a.params, b.params, atol=1e-6) for a, b in zip(cold, warm))


def test_experiments_start_at_the_first_ones_fit(spark, monkeypatch):
    df = frame(spark, rows_of(600, 9))
    samples = S.stratified_samples(df.select("case_id", "start", "end", "label", *NAMES), [40, 80], 4)
    calls, plain = [], margins.minimise

    def counted(rows, jobs, max_iter=60):
        calls.append((len(jobs), plain(rows, jobs, max_iter)))
        return calls[-1][1]

    monkeypatch.setattr(margins, "minimise", counted)
    assert M.sampling_experiment(df, df, samples, NAMES).count() == 8
    assert sum(n for n, _ in calls) == 8
    assert max(passes for n, passes in calls if n > 1) <= 5


def test_adding_up_holds_no_copy_of_a_batch():
    import tracemalloc

    import pyarrow as pa

    sums = [np.full(8192, float(k)).tobytes() for k in range(100)]
    batches = [pa.record_batch([pa.array([k % 2 for k in range(100)], pa.int64()), pa.array(sums, pa.binary())], ["job", "sums"]) for _ in range(3)]
    tracemalloc.start()
    got = {b.column("job")[0].as_py(): np.frombuffer(b.column("sums")[0].as_py())[0] for b in margins.add_up(iter(batches))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {0: 3.0 * sum(range(0, 100, 2)), 1: 3.0 * sum(range(1, 100, 2))}
    assert peak < len(sums) * len(sums[0]) / 4


def test_a_task_holds_features_of_one_map_and_sends_half_of_the_curvature():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(11)
    x, y, part = rng.normal(size=(3000, 64)), rng.integers(0, 2, 3000), rng.integers(0, 2, 3000)
    maps = [margins.kernel_map("rbf", np.arange(64), g, 3, x[:512], 256, 0.0) for g in (0.002, 0.005, 0.01, 0.02, 0.03, 0.05)]
    jobs = [margins.Job((c, k, p), m, c, part=p) for c in (0.1, 1.0) for k, m in enumerate(maps) for p in (0, 1)]  # maps take turns
    params = [rng.normal(size=j.map.width + 1) / 16 for j in jobs]
    batch = pa.record_batch([pa.nulls(3000, pa.string()), pa.array(part, pa.int64()), pa.array(y.astype(float)), pa.array(list(x))], ["fold", "part", "y", "x"])
    task = margins._task_sums([(k, j, params[k], 0.3) for k, j in enumerate(jobs)])
    tracemalloc.start()
    sent = {b.column("job")[0].as_py(): b.column("sums")[0].as_py() for b in task(iter([batch]))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = sum(8 * (1 + len(p) + len(p) ** 2) for p in params)
    assert peak < held + 8 * 2048 * 256 * 3  # the sums, and less than three of six maps' features of a chunk
    for k in (0, 5, len(jobs) - 1):
        assert len(sent[k]) < 8 * (1 + len(params[k]) + 0.51 * len(params[k]) ** 2)
        want = margins.margin_sums(jobs[k].map(x), np.where(y == 1, 1.0, -1.0), params[k], jobs[k].cost, 0.3, (part != jobs[k].part).astype(float))
        assert np.allclose(margins.whole(np.frombuffer(sent[k])), want, rtol=1e-9, atol=1e-9 * np.abs(want).max())


def test_tasks_of_a_pass_do_not_grow_with_the_partitions_of_the_rows(spark):
    df, n = frame(spark, rows_of(3000)), spark.sparkContext.defaultParallelism
    for pieces in (1, 40):
        rows = margins.prepare(df.repartition(pieces), NAMES)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == n and max(sizes) < 2 * 3000 / n
    files = margins.prepare(df, NAMES).repartition(10 * n)
    taken = []
    plain = type(files).mapInArrow

    def counted(self, *a, **b):
        taken.append(self.rdd.getNumPartitions())
        return plain(self, *a, **b)

    type(files).mapInArrow = counted
    try:
        margins.minimise(files, [margins.Job("one", margins.kernel_map("poly", np.arange(4), 0.3, 2, np.zeros((0, 4)), 64, 0.05), 1.0)], 1)
    finally:
        type(files).mapInArrow = plain
    assert taken[0] <= 4 * n
