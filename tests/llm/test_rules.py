"""Statistics against a plain version; rules against their meaning; verdicts on texts that were not learnt from."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import edge_rows, passage, table
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.llm import rules


def plain(text):
    text = text or ""
    count = Counter()
    for c in text:
        count["wide" if ord(c) >= 128 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "space" if c in " \t\n\x0b\f\r" else
              "symbol" if c in rules.SYMBOLS else "stop" if c in ".!?" else "pause" if c in ",;:" else "other"] += 1
    chars, letters = len(text) - count["space"], count["lower"] + count["upper"] + count["wide"]
    w = [x.decode() for x in text.encode().split()]
    lines = [tuple(x.encode().split()) for x in text.split("\n")]
    lines = [x for x in lines if x]
    div = lambda a, b: a / b if b else 0.0
    ascii_upper = lambda x: any("A" <= c <= "Z" for c in x) and not any("a" <= c <= "z" or ord(c) >= 128 for c in x)
    n = len(w)
    return [
        n, div(chars, n), div(count["upper"], letters), div(count["digit"], chars), div(count["symbol"], chars), div(count["stop"], chars), div(count["pause"], chars), div(count["wide"], chars),
        div(count["symbol"], n), div(sum(not any(c.isascii() and c.isalnum() or ord(c) >= 128 for c in x) for x in w), n), div(sum(map(ascii_upper, w)), n),
        div(sum(len(x.encode()) > 24 for x in w), n), div(sum(a == b for a, b in itertools.pairwise(w)), n), div(len(set(w)), n), div(max(Counter(w).values(), default=0), n), len(lines),
        div(len(set(lines)), len(lines)), div(n, len(lines)), div(sum(x[-1][-1:] in (b".", b"!", b"?") for x in lines), len(lines)), div(count["stop"], n),
    ]


def test_statistics(spark):
    rows = edge_rows() + [(700, "#*$ | <b> {x} & " * 8), (701, "A B c D. E!\n\nA B c D. E!\n1 22 x333 ☃ É"), (702, "w" * 40)]
    docs = table(spark, rows)
    got = docs.select("text", rules.measure(docs).alias("st")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["st"] == pytest.approx(plain(r["text"]), abs=1e-9)


def good_and_bad(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w = passage(rng, rng.randrange(30, 120))
        bad = k % 5 == 0
        if bad:
            w = [[x + rng.choice("#*$%&") for x in w], [y for x in w for y in (x, "|")], [x for x in w[:6] for _ in range(15)], [x.upper() + "!!" for x in w]][k // 5 % 4]
        rows.append((k, " ".join(w) + ".", 0 if bad else 1))
    return rows


def test_rate(spark):
    rows = good_and_bad(800, 2)
    docs = table(spark, [(i, t) for i, t, _ in rows] + [(None, "no id at all."), (None, None), (5, ""), (rows[1][0], rows[1][1])])
    truth = {i: y for i, _, y in rows}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    # Labels of held-out rows are the wrong way round: they have to have no say.
    labels = spark.createDataFrame([(i, 1 - y if i in held else y, "x") for i, y in truth.items()] + [(None, 0, "x"), (3, None, "x"), (9999, 1, "x"), (4, 7, "x")], "doc_id long, quality int, lang string")
    got = rules.rate(docs.withColumn("score", F.lit("theirs")).withColumn("st", F.lit("theirs")), labels).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    by_id = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] in held and r["doc_id"] != 5}
    assert sum(by_id[i] == truth[i] for i in by_id) >= 0.97 * len(by_id)
    scores = {r["score"] for r in got if r["doc_id"] == rows[1][0]}
    assert len(scores) == 1


def test_nothing_to_learn_from(spark):
    docs = table(spark, [(1, "Some text."), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["predicted"] for r in rules.rate(docs, none).collect()] == [0, 0]
    ones = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, quality int")
    assert [r["predicted"] for r in rules.rate(docs, ones).collect()] == [1, 1]
    assert rules.rate(table(spark, []), ones).count() == 0


def test_rules_are_tree_paths_and_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("st", T.ArrayType(T.DoubleType()))])
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(600, len(rules.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(int)
    data = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in enumerate(x)], schema)
    labels = spark.createDataFrame([(int(k), int(v)) for k, v in enumerate(y)], "doc_id long, quality int")
    model = rules.fit(data, labels, penalty=3e-3)
    assert 0 < len(model.rules) < 16 * 14 and any("upper_share" in str(r) and "stop_share" in str(r) for r in model.rules)
    got = {r["doc_id"]: r["s"] for r in data.select("doc_id", model.score(F.col("st")).alias("s")).collect()}
    for k, row in enumerate(x):
        logit = model.bias + sum(r.weight for r in model.rules if all(row[j] <= b if below else row[j] > b for j, below, b in r.terms))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12)
    assert np.mean([(got[k] >= 0.5) == y[k] for k in got]) > 0.95


def test_classify_keeps_rows_and_columns(spark):
    docs = table(spark, edge_rows()).withColumn("score", F.lit(777)).withColumn("row", F.lit("theirs"))
    out = rules.classify(docs, rules.Rules(0.0, [rules.Rule(((0, False, 10.0),), 2.0)]), names=("rated", "verdict"))
    assert out.columns == [*docs.columns, "rated", "verdict"]
    assert out.count() == len(edge_rows()) and out.filter("score = 777 AND row = 'theirs'").count() == len(edge_rows())
    assert out.filter("verdict = 1 AND rated > 0.3").count() == len(edge_rows())
