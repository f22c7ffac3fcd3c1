"""Folds, training statistics, report bundles, quantile ranks, trimmed blocks and outlier tables against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwise.operators import reports as R
from epochwise.operators import signal as G
from epochwise.operators import splits as S
from epochwise.operators import tracks as TR
from epochwise.sources import writers as B


def rows_of(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    data = [(int(c), float(k), float(k + 1), int(rng.random() < 0.3), float(rng.normal()), 1e9 + float(rng.normal())) for k, c in enumerate(rng.integers(0, 25, n))]
    return spark.createDataFrame(data, "case_id long, start double, end double, label int, x double, y double")


@pytest.mark.parametrize("test_size", [None, 0.2, 0.45, 0.02])
def test_folds_equal_the_row_by_row_way(spark, test_size):
    rows = rows_of(spark).cache()
    for part in (rows, rows.filter("label = 1"), rows.limit(7)):
        got = S.cross_validation_splits(part, 4, test_size)
        folds = S.case_folds(S.case_counts(part), 4).withColumnRenamed("fold", "_own")
        each = part.join(folds, "case_id").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3))))
        each = each.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")).drop("_own")
        want = S.balanced_split(each, test_size, 42, ["fold"])
        assert sorted(got.columns) == sorted(want.columns)
        got = got.select(*want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_folds_with_repeated_rows(spark):
    rows = rows_of(spark, 100).unionByName(rows_of(spark, 1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    got = S.cross_validation_splits(rows, 3, 0.3).groupBy("fold", "role", "label").count().collect()
    sizes = {(r["fold"], r["role"], r["label"]): r["count"] for r in got}
    each = S.cross_validation_splits(rows, 3, None).groupBy("fold", "role", "label").count().collect()
    whole = {(r["fold"], r["role"], r["label"]): r["count"] for r in each}
    assert all(whole.get((f, r, 0)) == whole.get((f, r, 1)) for f in range(3) for r in ("test", "train"))
    for f in range(3):
        test, train = (sum(sizes.get((f, r, c), 0) for c in (0, 1)) for r in ("test", "train"))
        if test:
            assert test / (test + train) == pytest.approx(0.3, abs=0.02)


def test_statistics_of_training_rows(spark):
    rows = rows_of(spark).cache()
    folds = S.disjoint_folds(S.case_counts(rows), 0.15, 12).cache()
    stats = {r["fold"]: r for r in S.training_statistics(rows, folds, ["x", "y"]).collect()}
    data, roles = rows.collect(), {(r["fold"], r["case_id"]): r["role"] for r in folds.collect()}
    assert len(stats) >= 4
    for fold, r in stats.items():
        own = [d for d in data if roles.get((fold, d["case_id"])) == "train"]
        for c in ("x", "y"):
            v = np.array([d[c] for d in own])
            assert r[f"m_{c}"] == pytest.approx(v.mean(), rel=1e-12) and r[f"s_{c}"] == pytest.approx(v.std(), rel=1e-6)
    scaled = S.scale_by_training(rows.join(folds, "case_id"), S.training_statistics(rows, folds, ["x", "y"]), ["x", "y"])
    check = scaled.filter("role = 'train'").groupBy("fold").agg(F.avg("x").alias("m"), F.stddev_pop("y").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1, abs=1e-6) for r in check)


def test_bundle_equals_single_reports(spark):
    rng = np.random.default_rng(5)
    data = [(int(k % 3), int(rng.random() < 0.5), int(rng.random() < 0.5), float(k), ["a", "b", None][k % 7 % 3], int(k % 4), float(rng.normal()), None if k % 5 == 0 else float(k)) for k in range(300)]
    df = R.with_error(spark.createDataFrame(data, "fold int, label int, prediction int, start double, kind string, site int, flat double, gappy double").withColumn("flat", F.lit(2.5)))
    got = R.result_bundles(df, ["kind", "site"], numeric=["gappy", "flat", "start"], worst=2)
    for c in ("kind", "site"):
        def of(report, *by, c=c):
            part = got[report].filter(F.col("variable") == c).drop("variable")
            return {tuple(r[b] for b in ("value", *by)): r for r in part.collect()}

        for report, want, by in (
            ("error", R.error_by_group(df, [c]), ()), ("error_label", R.error_by_group(df, [c], 1), ()), ("error_by_fold", R.error_by_group(df, ["fold", c]), ("fold",)),
            ("class_distribution", R.class_distribution(df, ["fold", c]), ("fold",)), ("confusion", R.confusion_by_group(df, [c]), ()), ("imperfect", R.imperfect_groups(df, [c]), ()),
        ):
            found = of(report, *by)
            rows = want.collect()
            assert len(rows) == len(found)
            for r in rows:
                mine = found[(None if r[c] is None else str(r[c]), *(r[b] for b in by))]
                assert all(mine[k] == pytest.approx(v) for k, v in r.asDict().items() if k not in (c, *by))
    metrics = {r["fold"]: r for r in R.fold_metrics(df).collect()}
    for r in got["metrics"].collect():
        assert all(r[c] == metrics[r["fold"]][c] for c in got["metrics"].columns)
    correlation = {r["variable"]: r["correlation"] for r in got["correlation"].collect()}
    pairs = [(r["gappy"], r["error"]) for r in df.collect() if r["gappy"] is not None]
    assert correlation["gappy"] == pytest.approx(np.corrcoef(*zip(*pairs))[0, 1]) and correlation["flat"] is None
    worst = got["temporal_error"].filter("variable = 'site'").select("value").distinct().count()
    assert worst == 2
    assert got["temporal_error"].columns == ["variable", "value", "start", "error"]


@pytest.mark.parametrize("per_channel", [False, True])
def test_quantile_ranks_over_several_ranges(spark, monkeypatch, per_channel):
    rng = np.random.default_rng(4)
    data = []
    for case, n in ((1, 333), (2, 40), (3, 1)):
        for i in range(n):
            a = 5.0 if i % 3 == 0 else float(np.round(rng.normal(), 1))  # one value in a third of all rows
            data.append((case, i, a, None if i % 17 == 0 else float(rng.integers(0, 50))))
    df = spark.createDataFrame(data, "case_id long, idx long, ch1 double, ch2 double")
    monkeypatch.setattr(G, "RANGE", 64)
    out = G.to_samples(G.normalize_waveform(G.to_blocks(df, 10, 16), "quantile", 16, per_channel=per_channel), 16).collect()
    got = {(r["case_id"], r["idx"]): (r["ch1"], r["ch2"]) for r in out}
    assert len(got) == len(data)
    for case in (1, 2, 3):
        own = [d for d in data if d[0] == case]
        values = [[d[2] for d in own], [d[3] for d in own if d[3] is not None]]
        pools = values if per_channel else [values[0] + values[1]] * 2
        for d in own:
            for c in (0, 1):
                x, pool = d[2 + c], sorted(pools[c])
                want = None if x is None or len(pool) < 2 else (sum(v < x for v in pool) + (pool.count(x) - 1) / 2) / (len(pool) - 1)
                assert got[case, d[1]][c] == (None if want is None else pytest.approx(want))


def test_channels_normalised_apart(spark):
    df = spark.createDataFrame([(1, i, float(i), 100.0 * i + 7) for i in range(50)], "case_id long, idx long, ch1 double, ch2 double")
    out = G.to_samples(G.normalize_waveform(G.to_blocks(df, 10, 16), "zscore", per_channel=True), 16).orderBy("idx").collect()
    assert all(r["ch1"] == pytest.approx(r["ch2"]) for r in out)
    assert out[0]["ch1"] == pytest.approx(-24.5 / np.std(np.arange(50)))


def test_trimmed_blocks_equal_trimmed_samples(spark):
    data = [(1, i, 0.0 if i < 21 or i > 90 else float(i % 7), 0.0 if i < 25 or i > 93 else 1.0) for i in range(111)]
    data += [(2, i, 0.0, 0.0) for i in range(20)] + [(3, i, 1.0, 0.0) for i in range(5)] + [(4, i, float(i == 3), 0.0) for i in range(40)]
    df = spark.createDataFrame(data, "case_id long, idx long, ch1 double, ch2 double")
    got = G.to_samples(TR.trim_zero_blocks(G.to_blocks(df, 10, 16), 16), 16)
    want = TR.trim_zero_rows(df, ["ch1", "ch2"]).select("case_id", "idx", "ch1", "ch2")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert TR.trim_zero_blocks(G.to_blocks(df, 10, 16), 16).filter("block > 0 AND size(ch1) > 16").isEmpty()


def test_outlier_tables_by_kind(spark, tmp_path):
    path = str(tmp_path)
    cases = spark.createDataFrame([(1,), (2,)], "group long")
    epochs = spark.createDataFrame([(1, 0.0, 2.0)], "case_id long, start double, end double")
    assert B.append_outliers(cases, path, "patient_id")[1] == 2 and B.append_outliers(epochs, path, "epoch")[1] == 1
    assert B.append_outliers(spark.createDataFrame([(2,), (3,)], "group long"), path, "patient_id")[1] == 1
    assert {r["group"] for r in B.read_outliers(spark, path, "patient_id").collect()} == {1, 2, 3}
    assert B.read_outliers(spark, path, "epoch").count() == 1
    for call in (lambda: B.append_outliers(cases, path, "invalid"), lambda: B.read_outliers(spark, path, "invalid")):
        with pytest.raises(ValueError, match="invalid"):
            call()


def test_waveform_files_hold_ranges_of_cases(spark, tmp_path):
    df = spark.createDataFrame([(c, i, float(i), 0.0) for c in range(20) for i in range(64)], "case_id long, idx long, ch1 double, ch2 double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        B.write_waveform(G.to_blocks(df.repartition(7), 10, 16), str(tmp_path / "w"), "raw")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "w")).groupBy(F.input_file_name().alias("f")).agg(F.min("case_id").alias("a"), F.max("case_id").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x["b"] <= y["a"] for x, y in zip(files, files[1:]))


def test_custom_splits_equal_the_splits_of_each_fold_and_store_no_rows(spark, monkeypatch):
    rows = spark.range(900).selectExpr("nullif(id % 30, 29) as case_id", "id as start", "id + 1 as end", "if(id % 7 < 3, 1, 0) as label")
    one, zero = (rows.filter(f"label = {k}").drop("label") for k in (1, 0))
    stored, store = {}, S.materialize

    def counted(df, name="stage", partition_by=None):
        out = store(df, name, partition_by)
        stored[name] = max(stored.get(name, 0), out.count() if "start" in out.columns else 0)
        return out

    monkeypatch.setattr(S, "materialize", counted)
    got = S.custom_splits(one, zero, 0.25, seed=3)
    columns = ["case_id", "start", "end", "label", "role", "fold"]
    got = sorted(tuple(r) for r in got.select(*columns).collect())
    assert not any(stored.values())
    known = rows.select("case_id", "start", "end", "label")
    folds = S.disjoint_folds(S.case_counts(known), 0.25, None, 3)
    want = S.balanced_split(known.join(folds, "case_id"), 0.25, 3, ["fold"]).select(*columns)
    assert got == sorted(tuple(r) for r in want.collect()) and {r[-1] for r in got} >= {0, 1}
