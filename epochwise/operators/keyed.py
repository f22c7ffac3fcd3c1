"""Filters, joins and set operations on epoch keys, cases and feature tables."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["case_id", "start", "end"]


def complete_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a null or NaN in any column."""
    return df.na.drop()


def exclude_cases(df: DataFrame, cases: DataFrame, column: str = "case_id") -> DataFrame:
    """Rows whose case is not listed."""
    return df.join(cases.select(column), column, "left_anti")


def misclassified(predictions: DataFrame, label: int = 1) -> DataFrame:
    """Keys of the wrongly predicted epochs of one label."""
    wrong = (F.col("label") == label) & (F.col("prediction") != F.col("label"))
    return predictions.filter(wrong).select(*KEYS).orderBy("case_id", "start", "end")


def drop_bands(df: DataFrame, wanted: Sequence[str], default: Sequence[str] = ("Delta", "Theta", "Alpha", "Beta")) -> DataFrame:
    """Remove band columns that are not configured."""
    return df.drop(*[b for b in default if b not in wanted])


def to_number(column: str) -> Column:
    """C11: number from text, null where it is blank or not a number."""
    return F.expr(f"try_cast(nullif(trim(`{column}`), '') AS double)")


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """C11: the named columns as numbers."""
    return df.select(*[to_number(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def map_categories(df: DataFrame, mapping: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Categories to numbers; unmapped values become null."""
    out = []
    for c in df.columns:
        if c not in mapping:
            out.append(F.col(c))
            continue
        table = F.create_map(*[F.lit(x) for k, v in mapping[c].items() for x in (k, float(v))])
        out.append(F.try_element_at(table, F.col(c)).alias(c))
    return df.select(*out)


def drop_degenerate_frequencies(spectra: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Remove a frequency from all sets when in some set it is not finite, all zero or constant.

    ``spectra``: ``set, freq_hz, psd`` (plus ``by``). Returns ``(kept, skipped)``.
    """
    p = F.col("psd")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    bad = ~F.bool_and(finite) | (F.min(p) == F.max(p))
    skipped = spectra.groupBy(*by, "set", "freq_hz").agg(bad.alias("bad")).filter("bad").drop("bad")
    frequencies = skipped.select(*by, "freq_hz").distinct()
    return spectra.join(frequencies, [*by, "freq_hz"], "left_anti"), skipped


def tag_and_round(first: DataFrame, second: DataFrame, tags: tuple[str, str], columns: Sequence[str], decimals: int = 2) -> DataFrame:
    """C14: union of two feature sets with a class column and rounded features."""
    both = first.withColumn("class", F.lit(tags[0])).unionByName(second.withColumn("class", F.lit(tags[1])))
    return both.select(*[F.round(c, decimals).alias(c) if c in columns else F.col(c) for c in both.columns])


def combine_features(tables: Mapping[str, DataFrame | None], keys: Sequence[str] = KEYS, normalize: bool = False, check: bool = True) -> DataFrame:
    """Inner join of feature tables on the epoch key, incomplete rows dropped, in the order of the key.

    Tables given as ``None`` are missing: they are skipped with a warning; no table at all is an error, and so
    is a join without rows if ``check`` (costs one row of work). ``normalize`` turns the features into
    z-scores. All tables are hash-partitioned on the same key, so each is exchanged once.
    """
    absent = [n for n, t in tables.items() if t is None]
    if absent:
        warnings.warn(f"feature tables left out because they are missing: {', '.join(absent)}", stacklevel=2)
    present = [t for t in tables.values() if t is not None]
    if not present:
        raise ValueError("there is no feature table to join")
    out = functools.reduce(lambda a, b: a.join(b, list(keys)), present).na.drop()
    if check and out.isEmpty():
        raise ValueError("the feature tables have no complete row in common")
    if normalize:
        from epochwise.operators.signal import zscore_columns

        out = zscore_columns(out, [c for c in numeric_columns(out) if c not in keys])
    return out.orderBy(*keys)


def remove_epochs(df: DataFrame, bad: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose epoch key is not among the listed ones."""
    return df.join(bad.select(*keys).distinct(), list(keys), "left_anti")


def split_by_outliers(df: DataFrame, outliers: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """``(inside, outside)`` of the outlier key set."""
    listed = outliers.select(*keys).distinct()
    return df.join(listed, list(keys), "left_semi"), df.join(listed, list(keys), "left_anti")


def label_outliers(df: DataFrame, outliers: DataFrame, label: int = 1, outlier_label: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Class ``label`` rows found among the outliers get their own label."""
    listed = outliers.select(*keys).distinct().withColumn("_hit", F.lit(True))
    flag = F.col("_hit").isNotNull() & (F.col("label") == label)
    return df.join(listed, list(keys), "left").withColumn(
        "label", F.when(flag, F.lit(outlier_label)).otherwise(F.col("label"))
    ).drop("_hit").select(*df.columns)


def outlier_sets(awake: DataFrame, faw: DataFrame, outliers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys with their set name: faw, wrong_awake (awake and outlier), correct_awake."""
    a, o = awake.select(*keys).distinct(), outliers.select(*keys).distinct()
    named = [
        (faw.select(*keys).distinct(), "faw"),
        (a.join(o, list(keys), "left_semi"), "wrong_awake"),
        (a.join(o, list(keys), "left_anti"), "correct_awake"),
    ]
    return functools.reduce(DataFrame.unionByName, [d.withColumn("set", F.lit(n)) for d, n in named])


def spectra_of(epochs: DataFrame, spectra: DataFrame, strict: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spectrum rows of the listed epochs.

    ``strict``: an epoch without spectrum is an error. Rows of an epoch whose number of frequencies
    differs from the others raise an error when they are read.
    """
    n = spectra.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.hash("freq_hz").cast("long")).alias("_axis"))
    hit = epochs.join(n, list(keys), "left" if strict else "inner")
    if strict:
        hit = hit.withColumn("_n", F.coalesce("_n", F.raise_error(F.lit("an epoch has no spectrum")).cast("long")))
    axes = hit.agg(F.min("_n").alias("_n0"), F.max("_n").alias("_n1"), F.min("_axis").alias("_x0"), F.max("_axis").alias("_x1"))
    same = (F.col("_n0") == F.col("_n1")) & (F.col("_x0") == F.col("_x1"))
    axes = axes.select(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("frequency axes differ"))).alias("_same"))
    return hit.select(*epochs.columns).join(spectra, list(keys)).filter(axes.scalar())


def imbalance_vs_metric(shares: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """Mean class share per fold next to the fold's metric."""
    mean = shares.groupBy("fold").agg(F.avg("rel_0").alias("rel_0"), F.avg("rel_1").alias("rel_1"))
    return mean.join(metrics.select("fold", metric), "fold")


def cohort_slice(metadata: DataFrame, cases: DataFrame, columns: Sequence[str], case: str = "case_id") -> DataFrame:
    """Metadata of the listed cases; ids are compared as text."""
    ids = cases.select(F.col(case).cast("string").alias(case)).distinct()
    return metadata.withColumn(case, F.col(case).cast("string")).join(ids, case, "left_semi").select(case, *columns)


def lookup_with_default(df: DataFrame, table: DataFrame, value: str, default: float, key: str = "case_id") -> DataFrame:
    """Value of a case from a lookup table, a default when the case is absent."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def missing_counterparts(source: DataFrame, target: DataFrame, key: str = "case_id") -> DataFrame:
    """Ids of the source without counterpart in the target, sorted."""
    return source.select(key).distinct().join(target.select(key), key, "left_anti").orderBy(key)


def ordered_output(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G1: rows ordered by key (a range exchange, no single-task sort)."""
    return df.orderBy(*keys)


def check_same_columns(a: DataFrame, b: DataFrame) -> None:
    """The two feature sets must have the same column list."""
    if a.columns != b.columns:
        raise ValueError("the two feature sets differ in their columns")


def labelled_union(
    class_1: DataFrame, class_0: DataFrame, ignore_cases: DataFrame | None = None, ignore_epochs: DataFrame | None = None
) -> DataFrame:
    """H1: both classes with their label, exclusions applied.

    ``orig_index`` is a hash of label and epoch key: it stays the same however the rows are partitioned.
    """
    check_same_columns(class_1, class_0)
    parts = []
    for df, label in ((class_1, 1), (class_0, 0)):
        df = df.withColumn("label", F.lit(label))
        if ignore_cases is not None:
            df = exclude_cases(df, ignore_cases)
        if ignore_epochs is not None:
            df = remove_epochs(df, ignore_epochs)
        parts.append(df)
    both = parts[0].unionByName(parts[1])
    return both.withColumn("orig_index", F.md5(F.concat_ws(":", "label", *KEYS)))


def _both_tables(a: DataFrame | None, b: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if a is None and b is None:
        raise ValueError("both tables are missing")
    return (a if a is not None else b.limit(0)), (b if b is not None else a.limit(0))


def compare_keys(a: DataFrame | None, b: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """H2: one row with ``a_in_b``, ``b_in_a`` and the number of keys missing on each side; no table is no keys."""
    a, b = _both_tables(a, b)
    side = [d.select(*keys, F.lit(i).alias("a"), F.lit(1 - i).alias("b")) for d, i in ((a, 1), (b, 0))]
    both = side[0].unionByName(side[1]).groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = both.agg(
        F.count_if((F.col("a") == 0)).alias("missing_from_a"), F.count_if(F.col("b") == 0).alias("missing_from_b")
    )
    return counts.select(
        (F.col("missing_from_b") == 0).alias("a_in_b"), (F.col("missing_from_a") == 0).alias("b_in_a"),
        "missing_from_a", "missing_from_b",
    )


def missing_keys(a: DataFrame | None, b: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """H2: keys present on one side only, with the side they are missing from; no table is no keys."""
    a, b = _both_tables(a, b)
    only_a = a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")
    only_b = b.select(*keys).distinct().join(a.select(*keys), list(keys), "left_anti")
    return only_a.withColumn("missing_from", F.lit("b")).unionByName(only_b.withColumn("missing_from", F.lit("a")))


def still_to_do(epochs: DataFrame, done: DataFrame | None, force: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """H3: epochs whose result is not stored yet; everything when forced or nothing is stored."""
    if force or done is None:
        return epochs
    return remove_epochs(epochs, done, keys)


def distinct_epochs(splits: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """H4: each epoch once over all folds."""
    return splits.dropDuplicates(list(keys))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
