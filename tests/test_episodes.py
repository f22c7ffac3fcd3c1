"""Episode mining against the literal row loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from epochwise.operators import episodes as E
from epochwise.operators import epochs as P
from epochwise.operators import tracks as T


def loop(bis, mac, thr_b, thr_m, m):
    """Episodes as (start row, end row); rows count from 0."""
    up = [b is not None and b > thr_b for b in bis]
    found, start = [], None
    for i in range(len(bis) - m):
        if start is None and all(up[i:i + m]) and all(x > thr_m for x in mac[i:i + m]):
            start = i
        elif start is not None and not up[i]:
            found.append((start, i - 1))
            start = None
    return found


@pytest.fixture(scope="module")
def random_tracks(spark):
    rng = random.Random(3)
    data, rows = {}, []
    for case in range(60):
        n = rng.randint(5, 120)
        bis = [rng.choice([None, 50.0]) if rng.random() < 0.25 else 80.0 for _ in range(n)]
        mac = [0.2 if rng.random() < 0.15 else 1.0 for _ in range(n)]
        data[case] = (bis, mac)
        rows += [(case, i, float(i), b, x) for i, (b, x) in enumerate(zip(bis, mac))]
    # One case much longer than the rest.
    bis = [rng.choice([50.0, 80.0, 80.0, 80.0, 80.0]) for _ in range(3000)]
    data[99] = (bis, [1.0] * 3000)
    rows += [(99, i, float(i), b, 1.0) for i, b in enumerate(bis)]
    df = spark.createDataFrame(rows, "case_id long, row_idx long, time double, bis double, mac double")
    return data, T.with_time_chunk(df, 16).cache()


def test_detection_sweep_equals_the_loop(random_tracks):
    data, df = random_tracks
    out = E.detect_episodes(df, [(70, 0.8), (40, 0.8)], [2, 3, 5], [4.0])
    got = {}
    for r in out.collect():
        got.setdefault((r["bis_threshold"], r["min_episode_length"], r["case_id"]), []).append((r["start"], r["end"], r["flagged"]))
    n = 0
    for thr in (70.0, 40.0):
        for m in (2, 3, 5):
            for case, (bis, mac) in data.items():
                eps = loop(bis, mac, thr, 0.8, m)
                flags = [
                    (j > 0 and eps[j][0] - eps[j - 1][1] < 4) or (j + 1 < len(eps) and eps[j + 1][0] - eps[j][1] < 4)
                    for j in range(len(eps))
                ]
                want = [(float(a), float(b), f) for (a, b), f in zip(eps, flags)]
                assert sorted(got.get((thr, m, case), [])) == want
                n += len(eps)
    assert n > 300


def test_merge_folds_flagged_neighbours(spark):
    rows = [(1, 0.0, 10.0, True), (1, 12.0, 20.0, True), (1, 23.0, 30.0, True), (1, 60.0, 70.0, False), (2, 71.0, 80.0, False)]
    df = spark.createDataFrame(rows, "case_id long, start double, end double, flagged boolean").withColumn("refractory_time", F.lit(5.0))
    out = E.merge_flagged(df, ["refractory_time", "case_id"], 10).collect()
    assert sorted((r["case_id"], r["start"], r["end"]) for r in out) == [(1, 0.0, 30.0), (1, 60.0, 70.0), (2, 71.0, 80.0)]


def test_windows(spark):
    df = spark.createDataFrame([(1, 0.5, 31.0), (1, 100.0, 109.0)], "case_id long, start double, end double")
    out = {(r["start"], r["end"]) for r in E.cut_windows(df, [10], [0.5]).collect()}
    want, t = set(), 0.5
    while t + 10 <= 31.0:
        want.add((float(math.ceil(t)), float(math.ceil(t + 10))))
        t += 5
    assert out == want
    with pytest.raises(ValueError):
        E.cut_windows(df, [0], [0.0])
    with pytest.raises(ValueError):
        E.cut_windows(df, [10], [1.0])


def test_extrapolation_uses_the_two_nearest_points(spark):
    vals = [None, None, 2.0, 4.0, None, 8.0, 9.0, None, None]
    rows = [(1, i, float(i), v) for i, v in enumerate(vals)] + [(2, 0, 0.0, 1.0), (2, 1, 1.0, None)]
    df = T.with_time_chunk(spark.createDataFrame(rows, "case_id long, row_idx long, time double, mac double"), 2)
    done, failed = T.interpolate_extrapolate(df)
    assert [r["mac"] for r in done.orderBy("row_idx").collect()] == [-2.0, 0.0, 2.0, 4.0, 6.0, 8.0, 9.0, 10.0, 11.0]
    assert [(r["case_id"], r["n_known"]) for r in failed.collect()] == [(2, 1)]


def test_held_ends(spark):
    a, b = [1.0, None, 3.0, 4.0], [None, 2.0, 3.0, None]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(zip(a, b))], "case_id long, idx long, ch1 double, ch2 double")
    out = T.interpolate_hold_ends(df.withColumn("chunk", F.floor(F.col("idx") / 2)), ["ch1", "ch2"]).orderBy("idx").collect()
    assert [r["ch1"] for r in out] == [1, 2, 3, 4]
    assert [r["ch2"] for r in out] == [2, 2, 3, 3]


def test_awake_epochs(spark):
    df = spark.createDataFrame([(5, 0.0, 30.0)], "case_id long, start double, end double")
    assert [(r["start"], r["end"]) for r in P.awake_epochs(df, 10, 10).orderBy("start").collect()] == [(0, 10), (10, 20)]
    cleaned = spark.createDataFrame([(5, 30.0, 50.0), (6, 0.0, 5.0)], "case_id long, start double, end double")
    assert [(r["case_id"], r["start"], r["end"]) for r in P.awake_epochs(cleaned, 10, 0).orderBy("start").collect()] == [(5, 30, 40), (5, 40, 50)]


def test_anesthesia_sampling(spark):
    df = spark.createDataFrame([(1, 1000, 60), (2, 1200, None)], "case_id long, duration long, anestart long")
    out = P.sample_anesthesia_epochs(df, 10, 5).collect()
    assert len(out) == 5 and all(r["case_id"] == 1 and 70 <= r["start"] <= 380 for r in out)
    assert len({r["start"] for r in out}) == 5
    assert len(P.sample_anesthesia_epochs(df, 10, 5, per_case=2).collect()) == 2
    short = spark.createDataFrame([(1, 700, 0)], "case_id long, duration long, anestart long")
    assert len(P.sample_anesthesia_epochs(short, 10, 100).collect()) == 8


def test_closed_interval_statistics(spark):
    tr = spark.createDataFrame([(1, float(t), None if t == 3 else float(t)) for t in range(10)], "case_id long, time double, bis_sr double")
    ep = spark.createDataFrame([(1, 2.0, 4.0), (1, 50.0, 60.0)], "case_id long, start double, end double")
    r = P.monitor_statistics(ep, tr, bucket=3.0).collect()
    assert len(r) == 1 and (r[0]["bis_sr_mean"], r[0]["bis_sr_min"], r[0]["bis_sr_max"]) == (2.0, 0.0, 4.0)


def test_unequal_tables_are_reported(spark):
    a = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)], "case_id long, row_idx long, bis double")
    b = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "case_id long, row_idx long, mac double")
    merged, unequal = T.merge_by_row(a, b, ["mac"])
    assert [(r["case_id"], r["mac"]) for r in merged.collect()] == [(2, 2.0)]
    assert [(r["case_id"], r["n_base"], r["n_other"]) for r in unequal.collect()] == [(1, 2, 1)]
