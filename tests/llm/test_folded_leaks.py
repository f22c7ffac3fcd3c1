"""Benchmark passages in another case or with other marks around their words."""

import random

from helpers import passage, table

import corpus_pipeline
from epochwise.llm import decontaminate


def test_folded_leaks(spark, tmp_path):
    rng = random.Random(8)
    item = passage(rng, 20)
    marks = ["-=" * k + "{" for k in range(1, 21)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(marks))], "item_id long, text string")
    filler = passage(rng, 30)
    rows = [
        (1, " ".join(filler + item)), (2, " ".join(filler + item).upper()), (3, " ".join(filler + [f"“{w}”," for w in item])), (4, " ".join(filler + marks)),
        (5, " ".join(filler)), (6, " ".join(w.upper() + "x" for w in item)), (7, None),
    ]
    docs = table(spark, rows)
    found = {(r["doc_id"], r["item_id"], r["n_matched"], r["start"]) for r in decontaminate.find_leaks(docs, items, folded=True).collect()}
    assert found == {(1, 1, 16, 30), (2, 1, 16, 30), (3, 1, 16, 30), (4, 2, 16, 30)}
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()} == {5, 6, 7}
