"""Stratified samples where rows share their keys."""

from pyspark.sql import functions as F

from epochwise.operators import splits as S


def test_samples_are_whole_when_keys_repeat(spark):
    n = 6000
    rows = spark.range(2 * n).select((F.col("id") % 2).cast("int").alias("label"), F.floor(F.col("id") / 2).alias("row"))
    key = F.when(F.col("row") < n // 2, F.lit(0)).otherwise(F.col("row"))  # one key holds half of each class
    rows = rows.select("label", "row", key.alias("case_id"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    got = S.stratified_samples(rows, [100, 1800], 4)
    counts = {(r["iteration"], r["size"], r["label"]): (r["n"], r["d"]) for r in got.groupBy("iteration", "size", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row").alias("d")).collect()}
    assert counts == {(i, s, y): (s // 2, s // 2) for i in range(4) for s in (100, 1800) for y in (0, 1)}


def test_samples_of_small_and_empty_classes(spark):
    rows = spark.range(30).select(F.when(F.col("id") < 5, 1).when(F.col("id") < 25, 0).alias("label"), F.col("id").alias("case_id"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    got = S.stratified_samples(rows, [20], 2).groupBy("iteration", "label").count().collect()
    assert {tuple(r) for r in got} == {(i, y, k) for i in range(2) for y, k in ((0, 10), (1, 5))}
    assert S.stratified_samples(rows.limit(0), [20], 2).count() == 0


def test_classes_are_not_exchanged(spark):
    rows = spark.range(5000).selectExpr("id % 50 as case_id", "id as start", "id + 2 as end", "cast(id % 2 as int) as label")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, store = [], S.materialize
    try:
        S.materialize = lambda df, name="stage", by=None: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or store(df, name, by)
        assert S.stratified_samples(rows, [20], 3).count() == 60
    finally:
        S.materialize = store
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
