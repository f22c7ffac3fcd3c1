"""Readers. Keys that the source layout keeps in file or folder names become typed columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators.keyed import check_same_columns
from epochwise.operators.ordered import scan
from epochwise.operators.tracks import HOUR, interpolate_hold_ends, nan_to_null, number_rows, with_time_chunk
from epochwise.params import EpisodeParams
from epochwise.session import materialize, new_path, release

CASE_FILE = r"(\d+)\.csv$"
TRACK_SCHEMA = "Time double, BIS_BIS double, BIS_SR double, Primus_MAC double"
COHORT_SCHEMA = (
    "caseid long, anestart double, age string, sex string, asa string, emop string, preop_htn string, preop_dm string, "
    "height string, weight string, death_inhosp string, los_icu string"
)


OPEN_COST = 64 << 10  # bytes that opening a file counts for when files are dealt to tasks


def _as_small_files(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """``run()`` under settings for many small files: what opening one counts for, and how many tasks list folders (up to 10,000 else, one folder each)."""
    own = {"spark.sql.files.openCostInBytes": OPEN_COST, "spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, str(value))
        return run()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows of many small files, read once and stored as one table.

    Spark counts 4 MB for a file, so a task would get a few files of a kilobyte, and every later pass would open them all again.
    """
    return _as_small_files(rows.sparkSession, lambda: materialize(rows, name))


def _stored_in_turn(spark: SparkSession, parts: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """Rows of all ``parts`` as one table. A part is asked for when the one before is stored, so the driver holds the files of one part."""
    path = new_path(spark, name)

    def run() -> DataFrame:
        for part in parts:
            part.write.mode("append").parquet(path)
            del part
            release(spark)
        return spark.read.schema(schema).parquet(path)

    return _as_small_files(spark, run)


def _groups(spark: SparkSession, path: str) -> list[str]:
    """The folders ``group=...`` below ``path``; the path itself if there is none. Other names beside groups are an error."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = files.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.globStatus(files.Path(at, "group=*")):
        return [path]
    names = [f.getPath().getName() for f in store.listStatus(at)]
    for name in names:
        if not name.startswith(("group=", ".")) and (not name.startswith("_") or "=" in name):
            raise ValueError(f"neither a group of spectra nor hidden: {name}")
    return [f"{path}/{name}" for name in sorted(names) if name.startswith("group=")]


def _case_id(pattern: str) -> Column:
    """Case id from the file path; null for files that are not named after a case."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("long")


def read_tracks(spark: SparkSession, path: str, pattern: str = CASE_FILE, schema: str = TRACK_SCHEMA, chunk_seconds: float = HOUR) -> DataFrame:
    """A1: monitor tracks, one file per case; NaN becomes null and rows are numbered in time order."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False).select(
        _case_id(pattern).alias("case_id"), *[F.col(c).alias(n) for c, n in zip(names, ("time", "bis", "bis_sr", "mac"))]
    )
    clean = with_time_chunk(nan_to_null(_stored(raw.filter("case_id is not null"), "track-rows"), "bis", "bis_sr", "mac"), chunk_seconds)
    return number_rows(clean, ["time"]).select("case_id", "row_idx", "time", "bis", "bis_sr", "mac", "chunk")


def _number_lines(df: DataFrame, attach: DataFrame | None = None) -> DataFrame:
    """0-based ``idx`` of each row in its case, from file order.

    A file split is the chunk: rows are numbered inside their split, splits are chained by position.
    """
    out = scan(df, ["case_id"], "_split", ["_line"], sums={"_n": F.lit(1)}, attach=attach)
    return out.withColumn("idx", F.col("_n") - 1).drop("_n", "_line")


def _position() -> list[Column]:
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    return [split.alias("_split"), F.monotonically_increasing_id().alias("_line")]


def read_waveform_csv(
    spark: SparkSession, path: str, pattern: str = CASE_FILE, columns: tuple[str, str] = ("BIS/EEG1_WAV", "BIS/EEG2_WAV"), fs: int = 128
) -> DataFrame:
    """A2: raw two-channel waveform; gaps are interpolated, ends take the nearest known value.

    Returns ``case_id, idx, ch1, ch2, fs``. Store the result: the index is fixed once, here.
    """
    schema = ", ".join(f"`{c}` double" for c in columns)
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False).select(
        _case_id(pattern).alias("case_id"), F.col(f"`{columns[0]}`").alias("ch1"), F.col(f"`{columns[1]}`").alias("ch2"), *_position()
    )
    numbered = materialize(_number_lines(nan_to_null(_stored(raw.filter("case_id is not null"), "wave-rows"), "ch1", "ch2")), "wave-lines")
    filled = interpolate_hold_ends(numbered, ["ch1", "ch2"], "case_id", "idx", "_split")
    return filled.select("case_id", "idx", "ch1", "ch2", F.lit(fs).alias("fs"))


def read_filtered_csv(spark: SparkSession, path: str, pattern: str = CASE_FILE) -> DataFrame:
    """A3: filtered waveform whose files start with ``# fs = N`` and the header ``1,2``.

    A case without a well-formed sampling-rate line is an error.
    """
    lines = spark.read.text(path).select(_case_id(pattern).alias("case_id"), "value", *_position()).filter("case_id is not null")
    rate = F.expr(r"try_cast(regexp_extract(value, '^# fs = (\\d+)\\s*$', 1) AS int)")
    fs = lines.filter(F.col("value").startswith("#")).groupBy("case_id").agg(F.max(rate).alias("fs"))
    parts = F.split("value", ",")
    data = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "1,2") & (F.trim("value") != "")).select(
        "case_id", parts[0].cast("double").alias("ch1"), parts[1].cast("double").alias("ch2"), "_split", "_line"
    )
    out = _number_lines(data, fs)
    message = F.concat(F.lit("Missing or malformed sampling rate line '# fs = <int>' in case "), F.col("case_id").cast("string"))
    return out.select("case_id", "idx", "ch1", "ch2", F.coalesce("fs", F.raise_error(message).cast("int")).alias("fs"))


def read_waveform(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """A4: one stage (raw, filtered, normalized) of the stored waveform; other stages are not read."""
    if stage not in ("raw", "filtered", "normalized"):
        raise ValueError(f"unknown waveform stage {stage!r}")
    return spark.read.parquet(path).filter(F.col("stage") == stage).drop("stage")


def read_epochs(spark: SparkSession, path: str, params: EpisodeParams) -> DataFrame:
    """A5: epochs of one parameter set by partition pruning; a set that was never written is an error."""
    df = spark.read.parquet(path)
    wanted = F.lit(True)
    for name, value in params.as_dict().items():
        wanted = wanted & (F.col(name) == F.lit(value))
    out = df.filter(wanted).drop(*params.as_dict())
    if out.isEmpty():
        raise FileNotFoundError(f"no epochs for {params.result_code()} {params.window_code()}")
    return out


def read_cohort(spark: SparkSession, path: str, schema: str = COHORT_SCHEMA) -> DataFrame:
    """Cohort metadata, one row per case."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False).withColumnRenamed("caseid", "case_id")


SPECTRUM = "case_id long, start long, end long, freq_hz double, psd double"


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra with the epoch key in the file name ``PSD_<start>_<end>_<case>``; other names are an error.

    The driver lists files before Spark reads them: where the path holds folders ``group=...``
    (``writers.write_spectrum_files``), they are read one after another, and what the driver holds does not grow with their number.
    """
    return _stored_in_turn(spark, (_spectra_of(spark, g) for g in _groups(spark, path)), SPECTRUM, "spectra-rows")


def _spectra_of(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+?)(?:\.csv)?(?:/part-[^/]*)?$", 1)
    raw = spark.read.csv(path, schema="Frequency_Hz double, PSD_V2_per_Hz double", header=True, enforceSchema=False).select(
        name.alias("_name"), F.col("Frequency_Hz").alias("freq_hz"), F.col("PSD_V2_per_Hz").alias("psd")
    )
    parts = F.split("_name", "_")
    bad = F.raise_error(F.concat(F.lit("not a spectrum file name: "), F.col("_name")))
    checked = raw.withColumn("_k", F.when((F.size(parts) == 4) & (parts[0] == "PSD"), parts).otherwise(bad.cast("array<string>")))
    keys = [F.col("_k")[i].cast("double").cast("long").alias(n) for i, n in ((3, "case_id"), (1, "start"), (2, "end"))]
    return checked.select(*keys, "freq_hz", "psd")


def read_predictions(spark: SparkSession, path: str, run: str) -> DataFrame:
    """Predictions of all folds of a run; keep them apart with ``groupBy('fold')``."""
    return spark.read.parquet(path).filter(F.col("run") == run).drop("run")


def read_feature_pair(spark: SparkSession, path: str, class_1: str, class_0: str) -> tuple[DataFrame, DataFrame]:
    """Feature sets of two classes; unequal column lists are an error."""
    pair = [spark.read.parquet(os.path.join(path, f"epoch_type={c}")) for c in (class_1, class_0)]
    check_same_columns(*pair)
    return pair[0], pair[1]


def list_cases(spark: SparkSession, path: str, pattern: str = CASE_FILE) -> DataFrame:
    """A10: distinct case ids from file names; only names are read, others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    number = F.expr("try_cast(_id AS bigint)").alias("case_id")
    return _stored(files.select(F.regexp_extract("path", pattern, 1).alias("_id")).select(number).filter("case_id is not null"), "case-files").distinct()


def read_run(runs: DataFrame, run: str) -> DataFrame:
    """The record of one run; an unknown run is an error."""
    found = runs.filter(F.col("run_name") == run)
    if found.isEmpty():
        raise ValueError(f"no run named {run!r}")
    return found


def run_cases(split_keys: DataFrame, run: str) -> DataFrame:
    """Cases finally used by a run."""
    return split_keys.filter(F.col("run") == run).select("case_id").distinct()


def run_folds(split_keys: DataFrame, run: str) -> DataFrame:
    """Number of epochs per fold and role of a run."""
    return split_keys.filter(F.col("run") == run).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


def read_analysis(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Stored analysis as CSV or JSON by extension."""
    kind = os.path.splitext(path)[1]
    if kind == ".csv":
        return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    if kind == ".json":
        return spark.read.json(path, schema=schema)
    raise ValueError(f"Unsupported file extension {kind!r}")
