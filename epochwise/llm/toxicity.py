"""Toxicity classifier: averaged subword embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.llm.runs import worker_slot
from epochwise.llm.words import content_tag

FEATURES = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("share", T.ArrayType(T.FloatType()))])


@dataclass
class Settings:
    """Sizes and training. ``per_class`` bounds the rows that are fitted; texts have any length."""

    buckets: int = 1 << 17
    width: int = 4
    shortest: int = 3
    longest: int = 5
    per_class: int = 4096
    least_docs: int = 5  # subwords of fewer documents of the sample are not tested
    false_share: float = 0.01  # of the subwords that are learnt, so many may tell nothing
    epochs: int = 15
    decay: float = 1e-5
    batch: int = 64
    rate: float = 0.02
    gain: float = 100.0  # the mean over a whole text is small; its scale is fixed, not learnt
    seed: int = 7


def subwords(word: bytes, s: Settings) -> list[int]:
    """Buckets of a word's character n-grams, with marks at both ends, and of the word itself."""
    marked = "<" + word.decode("utf-8", "replace").lower() + ">"
    if marked.isascii():  # bytes are characters
        flat = marked.encode()
        parts = [flat[i : i + n] for n in range(s.shortest, s.longest + 1) for i in range(len(flat) - n + 1)]
        parts.append(flat)
    else:
        parts = [marked[i : i + n].encode() for n in range(s.shortest, s.longest + 1) for i in range(len(marked) - n + 1)]
        parts.append(marked.encode())
    return [zlib.crc32(p) % s.buckets for p in parts]


def features(text: str | None, s: Settings, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weight of every bucket in a text's mean over words of the mean over a word's subwords.

    ``known`` keeps the buckets of words met before.
    """
    words = Counter((text or "").encode().split())
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    lists = []
    for word in words:
        found = known.get(word)
        if found is None:
            if len(known) >= 200_000:
                known.clear()
            found = known[word] = np.array(subwords(word, s), np.int32)
        lists.append(found)
    sizes = np.array([len(x) for x in lists])
    share = np.fromiter(words.values(), np.float64, len(words)) / (sum(words.values()) * sizes)
    bucket, place = np.unique(np.concatenate(lists), return_inverse=True)
    return bucket.astype(np.int32), np.bincount(place, np.repeat(share, sizes)).astype(np.float32)


@dataclass
class Bags:
    """Features of several texts, one after another: text ``i`` has entries ``at[i]`` to ``at[i + 1]``."""

    at: np.ndarray
    bucket: np.ndarray
    share: np.ndarray

    def only(self, kept: np.ndarray, buckets: int) -> Bags:
        """The entries of some buckets, numbered by their place in ``kept``."""
        place = np.full(buckets, -1, np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        new = place[self.bucket]
        taken = new >= 0
        return Bags(np.concatenate(([0], np.cumsum(taken)))[self.at], new[taken], self.share[taken])


def _fit_once(bags: Bags, buckets: int, labels: np.ndarray, weights: np.ndarray, epochs: int, decay: float, s: Settings) -> tuple[np.ndarray, float]:
    """Embeddings and softmax trained together by Adam on weighted cross-entropy.

    Returns the difference of the two classes' logits for each bucket, and the bias.
    """
    rng = np.random.default_rng(s.seed)
    embed = rng.normal(0, 0.1, (buckets, s.width)).astype(np.float32)
    soft = rng.normal(0, 0.1, (s.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [embed, soft, bias]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(labels), s.batch):
            part = order[a : a + s.batch]
            n = bags.at[part + 1] - bags.at[part]
            index = np.concatenate([bags.bucket[bags.at[i] : bags.at[i + 1]] for i in part])
            share = np.concatenate([bags.share[bags.at[i] : bags.at[i + 1]] for i in part]) * np.float32(s.gain)
            doc = np.repeat(np.arange(len(part)), n)
            mean = np.stack([np.bincount(doc, share * embed[index, d], len(part)) for d in range(s.width)], 1).astype(np.float32)
            logits = mean @ soft + bias
            g = np.exp(logits - logits.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(part)), labels[part]] -= 1
            g *= (weights[part] / weights[part].sum())[:, None].astype(np.float32)
            back = g @ soft.T
            pulled = np.stack([np.bincount(index, share * back[doc, d], buckets) for d in range(s.width)], 1).astype(np.float32)
            grads = [pulled + np.float32(decay) * embed, mean.T @ g, g.sum(0)]
            step += 1
            for q, m, v, d in zip(params, first, second, grads):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    slope = (embed @ (soft[:, 1] - soft[:, 0])) * s.gain
    return slope.astype(np.float32), float(bias[1] - bias[0])


def telling(bags: Bags, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets whose odds of standing in a text differ between the labels, either way.

    The difference of log odds is tested for every bucket of ``least_docs`` texts or more; of the tests those pass that keep the
    expected share of false ones below ``false_share`` (Benjamini and Hochberg 1995), so their number follows the labels.
    """
    doc = np.repeat(np.arange(len(labels)), np.diff(bags.at))
    n = [int((labels == y).sum()) for y in (0, 1)]
    c = [np.bincount(bags.bucket[labels[doc] == y], minlength=s.buckets) + 0.5 for y in (0, 1)]
    rest = [m + 1 - x for m, x in zip(n, c)]
    z = np.abs(np.log(c[1] / rest[1]) - np.log(c[0] / rest[0])) / np.sqrt(sum(1 / x for x in (*c, *rest)))
    tested = np.flatnonzero(c[0] + c[1] - 1 >= s.least_docs)
    p = np.array([math.erfc(v / math.sqrt(2)) for v in z[tested].tolist()])
    order = np.sort(p)
    passing = np.flatnonzero(order <= s.false_share * np.arange(1, len(p) + 1) / max(len(p), 1))
    return tested[p <= order[passing[-1]]] if len(passing) else tested[:0]


def fit(bags: Bags, labels: np.ndarray, weights: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Joint training over the :func:`telling` subwords; others would be learnt by heart.

    Returns a slope for each bucket (zero if it takes no part), and the bias.
    """
    kept = telling(bags, labels, s)
    slope = np.zeros(s.buckets, np.float32)
    found, bias = _fit_once(bags.only(kept, s.buckets), max(1, len(kept)), labels, weights, s.epochs, s.decay, s)
    slope[kept] = found[: len(kept)]
    return slope, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of the labelled documents: ``per_class`` ids of each class, by a hash of the id, and one text of each.

    Classes are weighted by their counts over all of ``labels``, so scores keep the true proportion. Labels
    that are neither 0 nor 1 are left out; an id with several labels counts as 1 if any is 1. With labels of
    one class or none, every score is the share of label 1 (0 without labels).
    """
    s = settings or Settings()
    one = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("own")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        share = 1 - 1e-6 if 1 in counts else 1e-6
        return np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share)))
    picks = [one.filter(F.col("y") == y).orderBy(F.xxhash64("own"), "own").limit(s.per_class) for y in (0, 1)]
    sample = picks[0].unionByName(picks[1])

    @F.arrow_udf(FEATURES)
    def of_text(text: pa.Array) -> pa.Array:
        known: dict[bytes, np.ndarray] = {}
        found = [features(t.as_py(), s, known) for t in text]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(b) for b, _ in found]))), pa.int32())
        flat = [pa.array(np.concatenate([x[k] for x in found]) if found else []) for k in (0, 1)]
        lists = [pa.ListArray.from_arrays(ends, x.cast(kind)) for x, kind in zip(flat, (pa.int32(), pa.float32()))]
        return pa.StructArray.from_arrays(lists, ["bucket", "share"])

    # An id may have many rows, some of them equal: of its texts the one with the least hash is taken, once.
    own = docs.select(F.col(id_col).alias("own"), F.struct(*content_tag(text_col)).alias("tag"), F.col(text_col).cast("string").alias("text"))
    one_text = own.select("own", "tag").join(F.broadcast(sample), "own").groupBy("own").agg(F.min("tag").alias("tag"), F.max("y").alias("y"))
    chosen = own.join(F.broadcast(one_text), ["own", "tag"])  # 2 * per_class rows at most are broadcast
    rows = chosen.select("own", "y", of_text("text").alias("x")).select("own", "y", "x.bucket", "x.share").dropDuplicates(["own"])

    def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by("own")
        del got
        y = table["y"].to_numpy().astype(np.int64)
        slope, bias = np.zeros(s.buckets, np.float32), float(np.log(counts[1] / counts[0]))
        if len(np.unique(y)) == 2:
            sizes = pc.list_value_length(table["bucket"]).to_numpy()
            bags = Bags(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), pc.list_flatten(table["bucket"]).to_numpy(), pc.list_flatten(table["share"]).to_numpy())
            slope, bias = fit(bags, y, np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum()), s)
        told = np.flatnonzero(slope)
        yield pa.record_batch([pa.array([told.astype(np.int32)]), pa.array([slope[told]]), pa.array([bias])], ["bucket", "slope", "bias"])

    # The sample is bounded, so one task can fit it, and the driver sees the few slopes alone.
    found = rows.repartition(1).mapInArrow(fit_rows, "bucket array<int>, slope array<float>, bias double").first()
    slope = np.zeros(s.buckets, np.float32)
    if found is None:
        return slope, float(np.log(counts[1] / counts[0]))
    slope[found["bucket"]] = found["slope"]
    return slope, found["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", settings: Settings | None = None) -> Column:
    """Probability of label 1 for a text: whole text, any length; null and empty texts get the bias alone.

    The mean of embeddings under a linear layer is a mean of numbers, one for each word; a worker remembers
    the numbers of up to a million words.
    """
    s = settings or Settings()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    class Slopes(dict):
        def __missing__(self, word: bytes) -> float:
            if len(self) >= 1_000_000:
                self.clear()
            out = self[word] = float(sent.value[0][subwords(word, s)].mean())
            return out

    run = uuid.uuid4().hex

    @F.arrow_udf("double")
    def of_text(text: pa.Array) -> pa.Array:
        slopes, bias, out = worker_slot("slopes", run, Slopes), sent.value[1], []
        for t in text:
            words = (t.as_py() or "").encode().split()
            logit = bias + (sum(map(slopes.__getitem__, words)) / len(words) if words else 0.0)
            out.append(1 / (1 + np.exp(-min(max(logit, -60.0), 60.0))))
        return pa.array(out, pa.float64())

    return of_text(text_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; null ids are not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3, settings: Settings | None = None) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; input columns of these names are replaced."""
    model = train(docs, labels.filter(~held_out(id_col)), id_col, text_col, settings=settings)
    scored = docs.withColumn("score", score(docs, model, text_col, settings))
    return scored.withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= cut).cast("int")})
