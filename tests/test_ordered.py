"""Chunked scans, ranks and percentiles against plain Python, on data with a hot group and ties."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochwise.operators import ordered as O


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(1)
    rows = []
    for case, n in ((1, 300), (2, 7), (3, 1)):
        t = 0
        for i in range(n):
            t += rng.choice([1, 1, 2, 40])
            rows.append((case, t, rng.choice([None, float(rng.randint(-4, 9))])))
    return rows, spark.createDataFrame(rows, "g int, t int, v double").withColumn("c", F.floor(F.col("t") / 20))


def test_scan_equals_plain_windows(series):
    rows, df = series
    v = F.col("v")
    out = O.scan(df, ["g"], "c", ["t"], sums={"s": F.coalesce(v, F.lit(0.0))}, lag={"lag": v}, lead={"lead": v}, ffill={"ff": v},
                 bfill={"bf": v}, totals={"n": F.lit(1)}, firsts={"first": v}, lasts={"last": v}).collect()
    got = {(r["g"], r["t"]): r for r in out}
    assert len(got) == len(rows)
    for g in (1, 2, 3):
        part = [(t, x) for gg, t, x in rows if gg == g]
        known = [x for _, x in part if x is not None]
        for i, (t, x) in enumerate(part):
            r = got[(g, t)]
            assert r["s"] == sum(y or 0 for _, y in part[: i + 1])
            assert r["n"] == len(part)
            assert r["lag"] == (part[i - 1][1] if i else None)
            assert r["lead"] == (part[i + 1][1] if i + 1 < len(part) else None)
            assert r["ff"] == next((y for _, y in reversed(part[: i + 1]) if y is not None), None)
            assert r["bf"] == next((y for _, y in part[i:] if y is not None), None)
            assert (r["first"], r["last"]) == ((known[0], known[-1]) if known else (None, None))


def test_rows_are_never_windowed_by_group_alone(series):
    """The row-level exchange and windows use (group, chunk); only chunk summaries meet per group."""
    _, df = series
    plan = O.scan(df.hint("merge"), ["g"], "c", ["t"], sums={"s": F.lit(1)})._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [x for x in plan.splitlines() if "Window" in x and "t#" in x.split("Window")[1]]
    assert row_windows and all("c#" in x for x in row_windows)


@pytest.mark.parametrize("size", [100_000, 7])
def test_cumulative(series, size):
    rows, df = series
    out = O.cumulative(df, ["g"], "v", {"n": F.count(F.lit(1))}, size).collect()
    for r in out:
        vals = [x for g, _, x in rows if g == r["g"] and x is not None]
        assert r["n"] == vals.count(r["v"])
        assert r["n_below"] == sum(x < r["v"] for x in vals)
        assert r["n_total"] == len(vals)


def test_percentiles_are_exact(series):
    rows, df = series
    out = O.percentiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "hi": 0.97}).collect()
    for r in out:
        vals = [x for g, _, x in rows if g == r["g"] and x is not None]
        assert np.allclose([r["q1"], r["m"], r["hi"]], np.percentile(vals, [25, 50, 97]))


@pytest.mark.parametrize("value", ["1.0 - id / 1e9", "1.7e9 + id"])
def test_close_values_are_cut_into_bounded_ranges(spark, value):
    df = spark.range(30_000).select(F.expr(value).alias("v"))
    ranged, levels = O.bounded_chunks(df, [], "v", 1000)
    assert ranged.groupBy(*levels).count().agg(F.max("count")).first()[0] <= 2000
    out = O.cumulative(df, [], "v", {"n": F.count(F.lit(1))}, rows_per_chunk=1000)
    assert out.agg(F.sum("n_below")).first()[0] == 30_000 * 29_999 // 2


def test_take_random_is_the_hash_order(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(90)], "g int, k int")
    got = {(r["g"], r["k"]) for r in O.take_random(df, ["g"], 7, ["k"], F.lit(5)).collect()}
    want = set()
    for g in range(3):
        keys = sorted((k for k in range(90) if k % 3 == g), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())
        want |= {(g, k) for k in keys[:5]}
    assert got == want
    assert got == {(r["g"], r["k"]) for r in O.take_random(df.repartition(7), ["g"], 7, ["k"], F.lit(5)).collect()}


def test_nested_chunks_are_bounded_and_ordered(spark):
    df = spark.createDataFrame([(i // 900, float(i * i % 1009) + i / 1e6) for i in range(1000)], "g int, v double")
    out, levels = O.bounded_chunks(df, ["g"], "v", 20, fan_out=8)
    pdf = out.toPandas().sort_values(["g", "v"])
    assert len(levels) == 2
    assert pdf.groupby(["g", *levels]).size().max() <= 45
    for _, part in pdf.groupby("g"):
        keys = list(zip(*[part[c] for c in levels]))
        assert keys == sorted(keys)


def test_ranges_of_a_large_group_are_not_dealt_by_group(spark):
    rows = spark.range(4000).selectExpr("if(id < 3900, 'large', 'small') as g", "cast(id * 7 % 4001 as double) as v")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, levels = O.bounded_chunks(rows, ["g"], "v", 100, 8)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and len(levels) == 2
        ranges = out.groupBy("g", *levels).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("v").alias("n")).orderBy("g", *levels).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(r["n"] for r in ranges) == 4000 and max(r["n"] for r in ranges) <= 200
    assert all(p["g"] != q["g"] or p["b"] < q["a"] for p, q in zip(ranges, ranges[1:]))
