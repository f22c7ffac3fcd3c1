"""Writers. Parameters, stages, folds and runs are partition columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators.ordered import join_small
from epochwise.operators.reports import with_error
from epochwise.params import EpisodeParams
from epochwise.session import materialize, release, spread


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Write and replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_waveform(blocks: DataFrame, path: str, stage: str, decimals: int | None = 4, float32: bool = False) -> None:
    """B1: waveform blocks of one stage, rounded or as float32; the sampling rate is a column.

    All stages of one table have the same sample type: keep float32 waveforms in their own table. Files hold ranges of
    case and block, so a reader that asks for a few cases opens few files.
    """
    def out(c: str) -> Column:
        if float32:
            return F.col(c).cast("array<float>").alias(c)
        return (F.transform(c, lambda x: F.round(x, decimals)) if decimals is not None else F.col(c)).alias(c)

    sorted_blocks = blocks.withColumns({"ch1": out("ch1"), "ch2": out("ch2"), "stage": F.lit(stage)}).repartitionByRange("case_id", "block").sortWithinPartitions("case_id", "block")
    _replace(sorted_blocks, path, "stage")


def write_spectra(spectra: DataFrame, path: str, tag: str = "epoch", keys: Sequence[str] = ("case_id", "start", "end")) -> None:
    """B2: long spectra under a tag (epoch, raw, filtered); a missing key is an error. Old rows of the tag go."""
    checked = spectra.select(*[
        F.coalesce(F.col(c), F.raise_error(F.lit(f"spectrum without {c}")).cast(t)).alias(c) if c in keys else F.col(c)
        for c, t in spectra.dtypes
    ])
    _replace(checked.withColumn("tag", F.lit(tag)), path, "tag")


FOLDERS = 10_000  # spectra that one job writes or reads, each in a folder of its own


def write_spectrum_files(spectra: DataFrame, path: str, name: str, n: int) -> None:
    """Long spectra as CSV in one folder for each value of the column ``name``, as ``group=<g>/<name>=<value>``; there are ``n`` values at most.

    The driver holds names and states of all files that a job writes or reads; so a job takes a group of about ``FOLDERS`` values, dealt by a hash.
    """
    groups = max(1, -(-n // FOLDERS))
    rows = materialize(spectra.withColumn("group", F.pmod(F.xxhash64(name), F.lit(groups)).cast("int")), "spectra-long", ["group"])
    for g in range(groups):
        # A folder a spectrum costs far more than its bytes: dealt to all tasks, one file each.
        spread(rows.filter(F.col("group") == g).drop("group"), name).write.partitionBy(name).csv(f"{path}/group={g}", header=True)
        release(rows.sparkSession)


def write_feature(features: DataFrame, path: str, feature: str, epoch_type: str) -> None:
    """One table per feature, partitioned by epoch type."""
    _replace(features.withColumn("epoch_type", F.lit(epoch_type)), f"{path}/{feature}", "epoch_type")


def write_feature_set(features: DataFrame, path: str, epoch_type: str) -> None:
    """Combined features of one epoch type, sorted by key inside the files."""
    _replace(features.withColumn("epoch_type", F.lit(epoch_type)).sortWithinPartitions("case_id", "start", "end"), path, "epoch_type")


def write_splits(splits: DataFrame, path: str) -> None:
    """``fold, role`` and rows; a row may be in many folds. A single split is fold 0."""
    if "fold" not in splits.columns:
        splits = splits.withColumn("fold", F.lit(0))
    folds = splits.agg(F.countDistinct("fold").alias("n_folds"))
    _replace(join_small(splits, folds, []), path, "fold", "role")


def write_predictions(predictions: DataFrame, path: str, run: str) -> None:
    """Test rows with prediction and error."""
    df = with_error(predictions).withColumn("run", F.lit(run))
    _replace(df if "fold" in df.columns else df.withColumn("fold", F.lit(0)), path, "run", "fold")


def write_epochs(epochs: DataFrame, path: str, params: EpisodeParams) -> None:
    """Epoch table of one parameter set, the counterpart of reader A5."""
    values = {k: F.lit(v) for k, v in params.as_dict().items()}
    _replace(epochs.withColumns(values), path, *values)


def append_unique(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Append the rows not stored yet (whole-row equality, nulls equal); returns them and their number."""
    spark = df.sparkSession
    try:
        old = spark.read.schema(df.schema).parquet(path)
        new = df.distinct().exceptAll(old.distinct())
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = df.distinct()
    new = materialize(new, "new_rows")
    new.write.mode("append").parquet(path)
    return new, new.count()


# The kinds of outliers that are kept.
OUTLIER_KINDS = ("epoch", "patient_id")


def append_outliers(outliers: DataFrame, path: str, kind: str) -> tuple[DataFrame, int]:
    """Append new outliers of a kind to its own table; returns those that were new and their number."""
    if kind not in OUTLIER_KINDS:
        raise ValueError(f"outliers are of a kind in {OUTLIER_KINDS}, not {kind!r}")
    return append_unique(outliers, f"{path}/outliers-{kind}")


def read_outliers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All outliers of a kind; none stored yet is an error of Spark's."""
    if kind not in OUTLIER_KINDS:
        raise ValueError(f"outliers are of a kind in {OUTLIER_KINDS}, not {kind!r}")
    return spark.read.parquet(f"{path}/outliers-{kind}")


def write_segments(segments: DataFrame, path: str, n: int, column: str = "eeg") -> None:
    """Wide segment matrix ``eeg_0 .. eeg_<n-1>`` with case, bounds and label."""
    keep = [c for c in segments.columns if c != column]
    segments.select(*keep, *[F.get(column, F.lit(i)).alias(f"{column}_{i}") for i in range(n)]).write.mode("overwrite").parquet(path)


def write_table(spark: SparkSession, data: DataFrame | Mapping, path: str) -> None:
    """A frame as CSV, a dict as JSON; anything else is an error."""
    if isinstance(data, DataFrame):
        data.write.mode("overwrite").csv(path, header=True)
    elif isinstance(data, Mapping):
        import json

        spark.createDataFrame([(json.dumps(dict(data), sort_keys=True),)], "value string").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"cannot store {type(data).__name__}")


def write_summary(summary: DataFrame, path: str, no_overwrite: bool = False) -> None:
    """Summary per parameter set; with ``no_overwrite`` an existing output stays as it is."""
    summary.write.mode("ignore" if no_overwrite else "overwrite").parquet(path)
