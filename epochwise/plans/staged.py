"""The whole way from raw waveform to error reports, stage tables in between."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators import signal as G
from epochwise.operators import splits as S
from epochwise.operators.epochs import epoch_samples
from epochwise.operators.keyed import labelled_union, still_to_do
from epochwise.operators.reports import result_bundles
from epochwise.plans.models import evaluate_folds
from epochwise.plans.runs import run_steps
from epochwise.session import materialize


def staged_run(
    raw: DataFrame, epochs: dict[str, DataFrame], features: Sequence[str], *, fs: int, block_len: int,
    class_1: str = "awake", class_0: str = "faw", low: float = 0.5, high: float = 30.0, order: int = 4, channel: int = 1,
    segment_seconds: float = 2, normalize: str = "zscore", test_size: float = 0.15, seed: int = 42, model: dict | None = None,
    done: dict[str, DataFrame] | None = None, steps: Sequence[str] | None = None, state: dict | None = None,
    fit_on: str = "all", metadata: DataFrame | None = None, groups: Sequence[str] = ("case_id",),
) -> dict:
    """Filter, normalize, transform, extract, combine, classify, analyze.

    ``done`` holds feature tables of earlier runs: their epochs are not computed again (H3). Every
    stage is a stored table, so a lost executor costs at most the running stage.

    ``fit_on``: features are z-scored by all rows (``all``), or in each fold by its training rows (``train``). Columns without
    spread take no part. ``metadata`` (one row a case) and ``groups``: columns by which the reports are made.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("features are fitted on all or on train")
    done = done or {}

    def filter_step(t: dict) -> None:
        t["filtered"] = materialize(G.filter_waveform(raw, fs, block_len, low, high, order), "filtered")

    def normalize_step(t: dict) -> None:
        t["normalized"] = materialize(G.normalize_waveform(t["filtered"], normalize, block_len), "normalized")

    def transform_step(t: dict) -> None:
        for kind in (class_1, class_0):
            todo = still_to_do(epochs[kind], done.get(kind))
            cut = epoch_samples(todo, t["normalized"], fs, block_len, channel, complete=True)
            t[f"spectra_{kind}"] = materialize(G.epoch_spectra(cut, fs, segment_seconds), f"spectra_{kind}")

    def extract_step(t: dict) -> None:
        for kind in (class_1, class_0):
            new = G.extract_features(t[f"spectra_{kind}"], features)
            old = done.get(kind)
            t[f"features_{kind}"] = new if old is None else new.unionByName(old.select(*new.columns))

    def combine_step(t: dict) -> None:
        rows = labelled_union(t[f"features_{class_1}"].na.drop(), t[f"features_{class_0}"].na.drop())
        columns = [c for c in rows.columns if c not in ("case_id", "start", "end", "label", "orig_index")]
        rows = materialize(rows, "combined")
        spread = rows.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
        t["columns"] = [c for c in columns if spread[c]]
        rows = rows.drop(*[c for c in columns if not spread[c]])
        t["rows"] = rows if fit_on == "train" else materialize(G.zscore_columns(rows, t["columns"]), "rows")

    def classify_step(t: dict) -> None:
        folds = S.disjoint_folds(S.case_counts(t["rows"]), test_size, int(1 // test_size) * 2, seed)
        splits = S.balanced_split(t["rows"].join(folds, "case_id"), test_size, seed, ["fold"])
        if fit_on == "train":
            splits = S.scale_by_training(splits, S.training_statistics(t["rows"], folds, t["columns"]), t["columns"])
        t["splits"] = materialize(splits, "splits")
        t["predictions"], t["metrics"] = evaluate_folds(t["splits"], t["columns"], **(model or {}))

    def analyze_step(t: dict) -> None:
        rows = t["predictions"] if metadata is None else t["predictions"].join(metadata, "case_id", "left")
        t["reports"] = result_bundles(rows, groups, splits=t["splits"], names={0: class_0, 1: class_1})

    return run_steps({
        "filter": filter_step, "normalize": normalize_step, "transform": transform_step, "extract": extract_step,
        "combine": combine_step, "classify": classify_step, "analyze": analyze_step,
    }, steps, state)
