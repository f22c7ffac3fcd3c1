"""The driver tables in the roles the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators.tracks import number_rows, with_time_chunk
from epochwise.session import load, materialize

CHUNK_HOURS = 240.0  # a few dozen rows per chunk in these tables
FS = 32  # samples per second of the embedding signals
BLOCK = 128  # samples per waveform block


def numbered_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as monitor tracks: case = user, time in hours, signals from value and props."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("double")
    raw = load(spark, sf, "events").select(
        F.col("user_id").alias("case_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9) - F.lit(473352.0)).alias("time"),
        "event_id",
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("bis"),
        k.alias("bis_sr"),
        F.when(F.col("event_id") % 7 != 0, k / 100).alias("mac"),
    )
    return number_rows(with_time_chunk(raw, CHUNK_HOURS), ["time", "event_id"]).select(
        "case_id", "row_idx", "time", "bis", "bis_sr", "mac", "chunk"
    )


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The tracks as a stored table, row numbers fixed once at ingest."""
    return materialize(numbered_tracks(spark, sf), "tracks")


TRACKS = r"""tracks AS (
  SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx,
    epoch_us(ts) / 3.6e9 - 473352.0 AS time,
    CASE WHEN event_id % 11 <> 0 THEN value END AS bis,
    CAST(regexp_extract(props, '"k": (\d+)', 1) AS DOUBLE) AS bis_sr,
    CASE WHEN event_id % 7 <> 0 THEN CAST(regexp_extract(props, '"k": (\d+)', 1) AS DOUBLE) / 100 END AS mac
  FROM events)"""


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    """``customer`` as case metadata; the anesthesia start is the account balance in seconds."""
    return load(spark, sf, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_acctbal").alias("anestart"), "c_mktsegment", "c_nationkey"
    )


COHORT = "cohort AS (SELECT c_custkey AS case_id, c_acctbal AS anestart, c_mktsegment, c_nationkey FROM customer)"


def features(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as a feature set: case = supplier, epoch key from order, line and part."""
    return load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("case_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("start"),
        F.col("l_partkey").alias("end"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )


FEATURES = """feats AS (
  SELECT l_suppkey AS case_id, l_orderkey * 8 + l_linenumber AS start, l_partkey AS "end",
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Feature set with the two classes R (1) and A (0) and a rule-based prediction."""
    f = features(spark, sf).filter(F.col("l_returnflag").isin("R", "A"))
    score = (F.col("l_quantity") * 13 + F.col("start") * 7 + F.col("case_id") * F.col("end")) % 100 / 100
    return f.withColumn("label", (F.col("l_returnflag") == "R").cast("int")).withColumn("score", score).withColumn(
        "prediction", (F.col("score") + 0.1 * F.col("label") >= 0.55).cast("int")
    ).withColumn("error", (F.col("label") != F.col("prediction")).cast("int")).withColumn("fold", F.pmod("case_id", F.lit(5)))


LABELLED = FEATURES + """, scored AS (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    (l_quantity * 13 + start * 7 + case_id * "end") % 100 / 100 AS score
  FROM feats WHERE l_returnflag IN ('R', 'A')), predicted AS (
  SELECT *, CASE WHEN score + 0.1 * label >= 0.55 THEN 1 ELSE 0 END AS prediction, case_id % 5 AS fold FROM scored),
  labelled AS (SELECT *, CASE WHEN label <> prediction THEN 1 ELSE 0 END AS error FROM predicted)"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """``labels`` with ``documents``: quality as truth, a length rule as prediction."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    d = load(spark, sf, "labels").join(docs, "doc_id")
    return d.select(
        "doc_id", "lang", "source", "n_chars", F.col("quality").alias("label"), "toxic",
        (F.col("n_chars") >= 600).cast("int").alias("prediction"),
    ).withColumn("error", (F.col("label") != F.col("prediction")).cast("int"))


JUDGED = """judged0 AS (
  SELECT d.doc_id, lang, source, n_chars, quality AS label, toxic, CASE WHEN n_chars >= 600 THEN 1 ELSE 0 END AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id), judged AS (
  SELECT *, CASE WHEN label <> prediction THEN 1 ELSE 0 END AS error FROM judged0)"""


def epoch_signals(spark: SparkSession, sf: str) -> DataFrame:
    """``embeddings`` as epoch signals of two seconds; class from the label, case from the id."""
    return load(spark, sf, "embeddings").select(
        (F.col("vec_id") % 40).alias("case_id"), F.col("vec_id").alias("start"), (F.col("vec_id") + 2).alias("end"),
        F.col("embedding").cast("array<double>").alias("eeg"), (F.col("label") >= 5).cast("int").alias("label"),
    )


SIGNALS = """signals AS (
  SELECT vec_id % 40 AS case_id, vec_id AS start, vec_id + 2 AS "end", CAST(embedding AS DOUBLE[]) AS eeg,
    CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label FROM embeddings)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings of a case strung together as a two-channel waveform, one row per sample."""
    s = load(spark, sf, "embeddings").select(
        (F.col("vec_id") % 40).alias("case_id"), F.floor(F.col("vec_id") / 40).alias("_k"),
        F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))).alias("_pos", "_s"),
    )
    return s.select(
        "case_id", (F.col("_k") * 64 + F.col("_pos")).alias("idx"),
        F.col("_s.a").cast("double").alias("ch1"), F.col("_s.b").cast("double").alias("ch2"),
    )


SAMPLES = """samples AS (
  SELECT case_id, k * 64 + pos AS idx, CAST(embedding[pos + 1] AS DOUBLE) AS ch1, CAST(embedding[64 - pos] AS DOUBLE) AS ch2
  FROM (SELECT vec_id % 40 AS case_id, vec_id // 40 AS k, embedding, unnest(range(64)) AS pos FROM embeddings))"""
