"""k-means of several subsets of one table at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.plans.margins import add_up
from epochwise.session import materialize

CHUNK = 4096  # rows whose distances are held at once


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T
    return np.maximum(square, 0)


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from hashes of rows; the same row has the same number wherever it is met."""
    # Multipliers of the public-domain murmur finaliser.
    z = h.view(np.uint64) ^ np.uint64(salt)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)) * 2.0**-53


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, row hashes, and the subsets of each row as a mask."""
    for whole in batches:
        for a in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(a, CHUNK)
            n = batch.num_rows
            x = np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)
            yield x, batch.column("h").to_numpy(), batch.column("mask").to_numpy()


class Passes:
    """Passes over the stored rows; each gives one array of sums for every subset."""

    def __init__(self, rows: DataFrame, names: list[str]) -> None:
        self.rows, self.names = rows, names

    def sums(self, of: Callable[[int, np.ndarray, np.ndarray], np.ndarray], todo: list[int]) -> dict[int, np.ndarray]:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for x, h, mask in _chunks(batches):
                for g in todo:
                    own = (mask >> g) & 1 == 1
                    if own.any():
                        part = of(g, x[own], h[own])
                        total[g] = total[g] + part if g in total else part
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["job", "sums"])

        found = self.rows.mapInArrow(task, "job long, sums binary").repartition(1, "job").mapInArrow(add_up, "job long, sums binary").collect()
        return {r["job"]: np.frombuffer(r["sums"]) for r in found}

    def chosen(self, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray], todo: list[int]) -> dict[int, np.ndarray]:
        """Different rows that ``keep`` takes; it takes a few of each subset."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, h, mask in _chunks(batches):
                for g in todo:
                    own = np.flatnonzero((mask >> g) & 1 == 1)
                    own = own[keep(g, x[own], h[own])] if len(own) else own
                    yield pa.record_batch([pa.array(np.full(len(own), g), pa.int64()), pa.array(list(x[own]), pa.list_(pa.float64()))], ["g", "x"])

        out: dict[int, list] = {g: [] for g in todo}
        for r in self.rows.mapInArrow(task, "g long, x array<double>").distinct().collect():
            out[r["g"]].append(r["x"])
        return {g: np.array(sorted(x)) for g, x in out.items()}


def _weighted_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of a few weighted points: k-means++ and its iterations."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(picked) < min(k, len(points)):
        far = _distances(points, points[picked]).min(1) * weights
        if far.sum() <= 0:
            break
        picked.append(int(rng.choice(len(points), p=far / far.sum())))
    centres = points[picked]
    for _ in range(30):
        near = _distances(points, centres).argmin(1)
        new = np.array([np.average(points[near == c], axis=0, weights=weights[near == c]) if weights[near == c].sum() > 0 else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


def kmeans_by(
    df: DataFrame, features: list[str], subsets: Mapping[str, Column], k: int = 3, max_iter: int = 300, tol: float = 1e-4, seed: int = 42, init_rounds: int = 2
) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """M6: cluster the rows of every subset (a name and a condition) on its own, all in the same passes.

    Returns the rows once for each subset they are in, with ``subset`` and ``cluster``; the centroids by subset and
    cluster; and the sum of squared distances by subset. Start points come from k-means|| with ``init_rounds`` rounds; draws depend on
    the row's values and the seed, so a subset has the result it has alone. A subset that has settled (no centroid
    moves by more than ``tol``) takes no part in later passes. Empty subsets have no centroids; a centroid without rows stays where
    it is. At most 62 subsets. Rows with a feature that is missing are in no subset.
    """
    names = list(subsets)
    if len(names) > 62:
        raise ValueError("at most 62 subsets at a time")
    x = F.array(*[F.col(c).cast("double") for c in features])
    known = ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    mask = sum((F.when(known & cond, 1 << g).otherwise(0).cast("long") for g, cond in enumerate(subsets.values())), F.lit(0).cast("long"))
    stored = materialize(df.select(F.struct(*df.columns).alias("row"), x.alias("x"), F.xxhash64(x).alias("h"), mask.alias("mask")).filter("mask <> 0"), "cluster-rows")
    passes = Passes(stored.select("x", "h", "mask"), names)
    # A row with the smallest hash is the first centroid.
    order = F.xxhash64(F.lit(seed), "h")
    first = stored.select(F.explode(F.array(*[F.when(F.col("mask").bitwiseAND(1 << g) != 0, g) for g in range(len(names))])).alias("g"), F.struct(order.alias("o"), "x").alias("c"))
    points = {r["g"]: np.array([r["c"]["x"]]) for r in first.filter("g IS NOT NULL").groupBy("g").agg(F.min("c").alias("c")).collect()}
    todo = sorted(points)
    for turn in range(init_rounds):
        far = passes.sums(lambda g, x, h, points=dict(points): np.array([_distances(x, points[g]).min(1).sum()]), todo)
        salt = (seed * 1_000_003 + turn + 1) & (1 << 63) - 1
        more = passes.chosen(lambda g, x, h, points=dict(points), far=far, salt=salt: _uniform(h, salt) * far[g][0] < 2 * k * _distances(x, points[g]).min(1), todo)
        points = {g: np.unique(np.vstack((p, more[g])), axis=0) if len(more.get(g, ())) else p for g, p in points.items()}
    weights = passes.sums(lambda g, x, h, points=dict(points): np.bincount(_distances(x, points[g]).argmin(1), minlength=len(points[g])).astype(float), todo)
    centres = {g: _weighted_start(points[g], weights[g], k, seed) for g in todo}
    width, cost = len(features), dict.fromkeys(names, 0.0)

    def moments(g: int, x: np.ndarray, h: np.ndarray, centres: dict[int, np.ndarray]) -> np.ndarray:
        far = _distances(x, centres[g])
        near = far.argmin(1)
        n = len(centres[g])
        sums = [np.bincount(near, minlength=n), *[np.bincount(near, x[:, c], n) for c in range(width)]]
        return np.concatenate(([far[np.arange(len(x)), near].sum()], np.stack(sums).ravel()))

    for turn in range(max_iter + 1):
        found = passes.sums(lambda g, x, h, centres=dict(centres): moments(g, x, h, centres), todo)
        still = []
        for g in todo:
            cost[names[g]] = float(found[g][0])
            n = len(centres[g])
            table = found[g][1:].reshape(width + 1, n)
            new = np.where(table[0] > 0, table[1:] / np.maximum(table[0], 1), centres[g].T).T
            if turn < max_iter and ((new - centres[g]) ** 2).sum(1).max() > tol * tol:
                still.append(g)
                centres[g] = new
        todo = still
        if not todo:
            break
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast({g: c for g, c in centres.items()})

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("g", T.IntegerType()), T.StructField("cluster", T.IntegerType())])))
    def nearest(x: pa.Array, mask: pa.Array) -> pa.Array:
        table = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), -1)
        bits = mask.to_numpy(zero_copy_only=False)
        out: list[list[dict]] = [[] for _ in range(len(x))]
        for g, c in sent.value.items():
            own = np.flatnonzero((bits >> g) & 1 == 1)
            for i, cluster in zip(own.tolist(), _distances(table[own], c).argmin(1).tolist()):
                out[i].append({"g": g, "cluster": cluster})
        return pa.array(out, pa.list_(pa.struct([("g", pa.int32()), ("cluster", pa.int32())])))

    tags = F.array(*[F.lit(n) for n in names])
    rows = stored.select("row", F.explode(nearest("x", "mask")).alias("c")).select("row.*", F.get(tags, F.col("c.g")).alias("subset"), F.col("c.cluster").alias("cluster"))
    flat = [(names[g], i, *map(float, c)) for g in sorted(centres) for i, c in enumerate(centres[g])]
    table = spark.createDataFrame(flat, "subset string, cluster int, " + ", ".join(f"`{f}` double" for f in features))
    return rows, table, cost
