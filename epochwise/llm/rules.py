"""Quality classifier: rules read off tree paths, weighted by a lasso, compiled into column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.llm import runs
from epochwise.session import materialize

# Kinds of bytes. In UTF-8 the later bytes of a character are no characters of their own.
LOWER, UPPER, DIGIT, SPACE, SYMBOL, STOP, PAUSE, WIDE, LATER, OTHER = range(10)
SYMBOLS = "#*$%&|<>@~^=_{}[]\\/+`"
STATISTICS = [
    "n_words", "word_chars", "upper_share", "digit_share", "symbol_share", "stop_share", "pause_share", "wide_share", "symbols_a_word", "bare_words", "upper_words", "long_words",
    "same_as_previous", "distinct_words", "commonest_word", "n_lines", "distinct_lines", "words_a_line", "closed_lines", "stops_a_word",
]


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (" \t\n\x0b\f\r", SPACE), (SYMBOLS, SYMBOL), (".!?", STOP), (",;:", PAUSE)):
        kind[[ord(c) for c in chars]] = k
    kind[128:192], kind[192:] = LATER, WIDE
    return kind


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of stretches ``at[i]`` to ``at[i + 1]``, zero for empty ones."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different keys of each text, and of its commonest key."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    begin = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, d[begin], np.diff(np.concatenate((begin, [len(d)]))))
    return np.bincount(d[begin], minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """``STATISTICS`` of whole texts, a row each; shares of nothing are 0."""
    raw, at = runs.texts(column)
    n = len(at) - 1
    if not n:
        return np.zeros((0, len(STATISTICS)))
    kind = _kinds()[raw]
    count = np.array([np.bincount(kind[a:b], minlength=10) for a, b in zip(at, at[1:])], float)
    chars = count.sum(1) - count[:, LATER] - count[:, SPACE]
    letters = count[:, LOWER] + count[:, UPPER] + count[:, WIDE]
    start, end, first, (keys,) = runs.words(raw, at, runs.SEEDS[:1])
    n_words = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    has = {}
    for name, kinds in (("word", (LOWER, UPPER, DIGIT, WIDE)), ("lower", (LOWER, WIDE)), ("upper", (UPPER,))):
        total = np.concatenate(([0], np.cumsum(np.isin(kind, kinds), dtype=np.int32)))
        has[name] = total[end] > total[start]
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
    distinct, commonest = _distinct(doc, keys, n)
    # Lines with at least one word, as chains of their words' hashes.
    line = np.searchsorted(np.flatnonzero(raw == 10), start)
    opens = np.ones(len(start), bool)
    opens[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(opens)
    n_lines = np.bincount(doc[begin], minlength=n).astype(float)
    place = (np.arange(len(start)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(start)]))))).astype(np.uint64)
    chained = np.add.reduceat(runs.mix(keys + place * np.uint64(0x9E3779B97F4A7C15)), begin) if len(begin) else keys
    distinct_lines = _distinct(doc[begin], chained, n)[0]
    last_of_line = np.concatenate((begin[1:], [len(start)]))[: len(begin)] - 1
    closed = np.bincount(doc[begin], kind[end[last_of_line] - 1] == STOP, n) if len(begin) else np.zeros(n)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.divide(x, of, out=np.zeros(n), where=of > 0)

    return np.stack([
        n_words, share(chars, n_words), share(count[:, UPPER], letters), share(count[:, DIGIT], chars), share(count[:, SYMBOL], chars), share(count[:, STOP], chars), share(count[:, PAUSE], chars),
        share(count[:, WIDE], chars), share(count[:, SYMBOL], n_words), share(_sums(~has["word"], first), n_words), share(_sums(has["upper"] & ~has["lower"], first), n_words),
        share(_sums(end - start > 24, first), n_words), share(_sums(same, first), n_words), share(distinct, n_words), share(commonest, n_words), n_lines, share(distinct_lines, n_lines),
        share(n_words, n_lines), share(closed, n_lines), share(count[:, STOP], n_words),
    ], 1)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics_of(text: pa.Array) -> pa.Array:
    parts = [statistics(b.column(0)) for b in runs.small_batches([pa.record_batch([text], ["text"])], "text")]
    found = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(STATISTICS), pa.int32()), pa.array(found.ravel()))


def measure(docs: DataFrame, text_col: str = "text") -> Column:
    """Statistics of a whole text as an array of numbers, in the order of ``STATISTICS``; null counts as empty."""
    return _statistics_of(F.coalesce(docs[text_col].cast("string"), F.lit("")))


@dataclass
class Rule:
    """A conjunction of ``statistic <= bound`` (or ``>``), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, st: Column) -> Column:
        parts = [st[k] <= F.lit(bound) if below else st[k] > F.lit(bound) for k, below, bound in self.terms]
        return reduce(Column.__and__, parts)

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'<=' if below else '>'} {bound:.6g}" for k, below, bound in self.terms)


@dataclass
class Rules:
    """Logistic model over rules; ``bias`` alone where nothing could be learnt."""

    bias: float
    rules: list[Rule] = field(default_factory=list)

    def score(self, st: Column) -> Column:
        """Probability of label 1 from the statistics, as a plain column expression."""
        logit = reduce(Column.__add__, [F.when(r.holds(st), r.weight).otherwise(0.0) for r in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))


def _paths(node, above: tuple = ()) -> list[tuple]:
    """Conditions that lead to every node below the root, the same statistic's bounds merged into the tightest."""
    if node.subtreeDepth() == 0:
        return []
    split = node.split()
    k, bound = split.featureIndex(), split.threshold()
    found = []
    for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
        old = [t for t in above if t[:2] == (k, below)]
        tight = min([bound, *[t[2] for t in old]]) if below else max([bound, *[t[2] for t in old]])
        terms = tuple(sorted([t for t in above if t[:2] != (k, below)] + [(k, below, tight)]))
        found += [terms, *_paths(child, terms)]
    return found


def fit(
    measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", statistics_col: str = "st", per_class: int = 20_000, trees: int = 16, depth: int = 3,
    penalty: float = 1e-3, seed: int = 11,
) -> Rules:
    """Learn rules from ``measured`` rows (``id_col``, ``statistics_col``) that have a label.

    Of each class about ``per_class`` rows are taken, by a hash of the id, and weighted so that the classes keep their
    true proportion. Paths of a random forest's shallow trees become rules, 0 or 1 for a row; a logistic fit with an L1
    penalty gives most of them no weight. Forest and fit are distributed jobs; the driver sees trees and weights.

    Labels other than 0 and 1, and rows without id, are left out; an id with several labels counts as 1 if any is 1.
    With one class or no label the score is the share of label 1 (0 without labels).
    """
    one = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("own")).agg(F.max(label_col).cast("int").alias("y"))
    rows = measured.select(F.col(id_col).cast("long").alias("own"), F.col(statistics_col).alias("st")).join(one, "own")
    rows = materialize(rows, "labelled")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        share = 1 - 1e-6 if 1 in n else 1e-6
        return Rules(math.log(share / (1 - share)))
    place = (F.xxhash64("own") % 1_000_000 + 1_000_000) % 1_000_000
    kept = {y: min(1.0, per_class / n[y]) for y in (0, 1)}
    share = F.when(F.col("y") == 1, kept[1]).otherwise(kept[0])
    chosen = rows.filter(place < share * 1_000_000).select(F.col("y").cast("double").alias("y"), "st", (1 / share).alias("weight"), array_to_vector("st").alias("x"))
    chosen = materialize(chosen.repartition(max(1, min(200, sum(min(per_class, c) for c in n.values()) // 5000 + 1))), "chosen")
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed).fit(chosen)
    found = dict.fromkeys(path for tree in forest.trees for path in _paths(tree._java_obj.rootNode()))
    rules = [Rule(path) for path in found]
    if not rules:
        share = n[1] / (n[0] + n[1])
        return Rules(math.log(share / (1 - share)))
    as_numbers = F.array(*[r.holds(F.col("st")).cast("double") for r in rules])
    table = materialize(chosen.select("y", "weight", array_to_vector(as_numbers).alias("r")), "rules")
    lasso = LogisticRegression(featuresCol="r", labelCol="y", weightCol="weight", regParam=penalty, elasticNetParam=1.0, maxIter=60).fit(table)
    weights = lasso.coefficients.toArray()
    return Rules(float(lasso.intercept), [Rule(r.terms, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; null ids are not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, **options) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``, and its ``statistics``.

    Every text is read once: its statistics are stored, learnt from where a label is known, and scored by the rules.
    Null and empty texts have statistics of 0 and a score like any other; equal rows are rated alike; other columns are
    ignored. An empty table gives an empty table. Labels of held-out ids are not used.
    """
    measured = materialize(docs.select(F.col(id_col), measure(docs, text_col).alias("st")), "statistics")
    model = fit(measured, labels.filter(~held_out(id_col)), id_col, **options)
    scored = measured.select(F.col(id_col), held_out(id_col).alias("held_out"), model.score(F.col("st")).alias("score"), F.col("st").alias("statistics"))
    return scored.select(id_col, "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), "statistics")


def classify(docs: DataFrame, model: Rules, text_col: str = "text", cut: float = 0.3, names: Sequence[str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the score of a fitted model and its verdict in new columns; columns of these names are replaced."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), measure(docs, text_col).alias("st")).select("row", model.score(F.col("st")).alias("score"))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in names]
    return inner.select(*kept, F.col("score").alias(names[0]), (F.col("score") >= cut).cast("int").alias(names[1]))
