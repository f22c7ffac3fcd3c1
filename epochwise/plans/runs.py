"""Run registry and staged jobs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.operators.ordered import join_small
from epochwise.params import EPOCH_TYPES

RUN_SCHEMA = (
    "run_name string, created string, epoch_types array<string>, model string, params string, metrics string, param_hash string, "
    "normalise string, feature_params string, final_cases array<bigint>"
)


@dataclass(frozen=True)
class RunSettings:
    """Everything that identifies a run; what is chosen for a table of features belongs to the record alone."""

    epoch_types: Sequence[str]
    model: Mapping[str, Mapping]
    initial_cases: Iterable[int] = ()
    hyperparameters: Mapping = field(default_factory=dict)
    filtering: Mapping = field(default_factory=dict)
    transform: Mapping = field(default_factory=dict)
    classification: Mapping = field(default_factory=dict)
    normalise: str | None = None
    feature_params: Mapping = field(default_factory=dict)

    def __post_init__(self) -> None:
        for t in self.epoch_types:
            if t not in EPOCH_TYPES:
                raise ValueError(f"{t!r} is no kind of epoch")

    def as_row(self, spark: SparkSession) -> DataFrame:
        """One row: ``epoch_types, model, params`` and ``param_hash``, the SHA-256 of ``params``.

        ``params`` is Spark's JSON of a struct of named parts; lists are sorted, maps by key.
        """
        parts = {
            "model": self.model, "tuning": self.hyperparameters, "filter": self.filtering, "spectrum": self.transform,
            "classes": self.classification, "features": self.feature_params,
        }
        texts = [json.dumps(v, sort_keys=True) for v in parts.values()]
        row = (list(self.epoch_types), next(iter(self.model)), [int(c) for c in self.initial_cases], self.normalise, *texts)
        schema = "epoch_types array<string>, name string, cases array<bigint>, normalise string, " + ", ".join(f"{p} string" for p in parts)
        params = F.to_json(F.struct(F.sort_array("epoch_types").alias("epochs"), F.sort_array("cases").alias("cases"), "normalise", *parts))
        one = spark.createDataFrame([row], schema)
        return one.select("epoch_types", F.col("name").alias("model"), params.alias("params"), F.sha2(params, 256).alias("param_hash"), "normalise", F.col("features").alias("feature_params"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_SCHEMA).parquet(f"{path}/runs")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RUN_SCHEMA)


def register_run(
    spark: SparkSession, path: str, settings: RunSettings, splits: DataFrame, metrics: DataFrame,
    run_name: str | None = None, force: bool = False, now: datetime | None = None,
) -> str:
    """Store the record of a run and return its name.

    A run with the same parameters is refused unless forced. Of the wished name and the same name with the time
    behind it, the first that is free is taken. The epoch keys of the folds go to their own table
    ``split_keys``, since they grow with the data; the record lists the cases they end with.
    """
    now = now or datetime.now()
    second = now.strftime("%Y_%m_%dT%H_%M_%S")
    known, row = read_runs(spark, path), settings.as_row(spark)
    twin = known.join(row, "param_hash", "left_semi").select("run_name").first()
    if twin and not force:
        raise ValueError(f"run {twin['run_name']!r} is stored with these parameters")
    wished = [run_name, f"{run_name}_{second}"] if run_name else [f"Run_{second}", f"Run_{second}_{second}"]
    names = spark.createDataFrame(list(enumerate(wished)), "place int, run_name string")
    name = names.join(known, "run_name", "left_anti").orderBy("place").first()["run_name"]
    # One row per fold: few, so the metrics fit into one JSON field of the record. Cases are ids, far fewer than epochs.
    summary = metrics.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*metrics.columns)))).alias("metrics"))
    cases = splits.agg(F.sort_array(F.collect_set(F.col("case_id").cast("long"))).alias("final_cases"))
    record = join_small(join_small(row, summary, []), cases, []).select(
        F.lit(name).alias("run_name"), F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).alias("created"), "epoch_types", "model", "params", "metrics", "param_hash",
        "normalise", "feature_params", "final_cases",
    )
    record.write.mode("append").parquet(f"{path}/runs")
    splits.select(F.lit(name).alias("run"), "fold", "role", "case_id", "start", "end").write.mode("append").partitionBy("run").parquet(f"{path}/split_keys")
    return name


STEPS = ("filter", "normalize", "transform", "extract", "combine", "classify", "analyze")


def run_steps(steps: Mapping[str, Callable[[dict], None]], selected: Sequence[str] | None = None, state: dict | None = None) -> dict:
    """Run the selected steps in their fixed order on a shared dict of tables; None selects all.

    A step reads the tables it needs from the dict and puts its result there.
    """
    unknown = [s for s in (selected or []) if s not in STEPS]
    if unknown:
        raise ValueError(f"no such steps: {unknown}; there are {list(STEPS)}")
    state = {} if state is None else state
    for name in STEPS:
        if (selected is None or name in selected) and name in steps:
            steps[name](state)
    return state
