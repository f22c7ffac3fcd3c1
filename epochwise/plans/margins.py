"""Margin classifiers, many at a time: one pass over the rows serves every model of a sweep.

The objective is that of a support vector machine, ``|w|^2 / 2 + C * sum(loss(y * f(x)))``, with the hinge rounded at its
corner: ``loss(z) = d * log(1 + exp((1 - z) / d))``. It lies above the hinge by at most ``d * log 2`` a row, and is smooth, so
Newton's method settles in a few passes. In a pass every task adds up value, gradient and curvature of all models
over its rows; the sums of a model meet in one task; the driver, which holds nothing but models, takes their next steps.
Tasks are as many as the cluster runs at once, or a few times that, so neither what a pass exchanges nor what a task holds grows with the rows.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable, Hashable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.operators.ordered import take_random
from epochwise.session import materialize

CORNER = 0.1  # d above
PARTS = 5  # parts of the training rows whose margins come from models that have not seen them
PASS_BYTES = 1 << 26  # sums of all models in a pass; more models take several passes
CHUNK = 2048  # rows that are taken from a batch at once
WIDE = 96  # columns of models on plain columns up to which all of them share the products of columns
CELLS = 1 << 17  # margins of rows by models that are held at once
HELD = 1 << 18  # features of rows that are held at once


# ---------------------------------------------------------------------------------------------
# Kernels as features


@dataclass
class FeatureMap:
    """Features whose inner products are (nearly) a kernel's values on the chosen columns, scaled first if asked for.

    ``linear``: the columns. ``products``: all products of ``degree`` columns, exact for ``(gamma x.y) ** degree``.
    ``rbf`` and ``poly`` with landmarks: ``k(x, landmarks) @ projection`` (Nystroem).
    """

    kernel: str
    columns: np.ndarray
    gamma: float = 1.0
    degree: int = 3
    landmarks: np.ndarray | None = None
    projection: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    error: float = 0.0  # of the kernel, relative, as measured
    picks: list[tuple[int, ...]] | None = None
    weights: np.ndarray | None = None

    @property
    def width(self) -> int:
        return len(self.columns) if self.kernel == "linear" else len(self.picks) if self.picks else self.projection.shape[1]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.columns]
        if self.mean is not None:
            x = np.divide(x - self.mean, self.scale, out=np.zeros_like(x), where=self.scale > 0)
        return x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        if self.kernel == "linear":
            return x
        if self.picks is not None:
            out = np.repeat(self.weights[None], len(x), 0)
            for at in range(self.degree):
                out *= x[:, [p[at] for p in self.picks]]
            return out
        return kernel_values(self.kernel, x, self.landmarks, self.gamma, self.degree) @ self.projection


def kernel_values(kernel: str, x: np.ndarray, y: np.ndarray, gamma: float, degree: int = 3) -> np.ndarray:
    if kernel == "rbf":
        square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
        return np.exp(-gamma * np.maximum(square, 0))
    if kernel == "poly":
        return (gamma * (x @ y.T)) ** degree
    raise ValueError(f"unknown kernel {kernel!r}")


def products(columns: np.ndarray, gamma: float, degree: int, **scaling) -> FeatureMap:
    """All products of ``degree`` columns with the root of their multinomial weight."""
    picks = list(itertools.combinations_with_replacement(range(len(columns)), degree))
    ways = [math.factorial(degree) // math.prod(math.factorial(p.count(i)) for i in set(p)) for p in picks]
    return FeatureMap("poly", columns, gamma, degree, picks=picks, weights=np.sqrt(np.array(ways) * gamma**degree), **scaling)


def kernel_map(
    kernel: str, columns: np.ndarray, gamma: float, degree: int, sample: np.ndarray, most: int, bound: float, mean: np.ndarray | None = None, scale: np.ndarray | None = None
) -> FeatureMap:
    """Features of a kernel. Landmarks are rows of ``sample``, doubled until the measured error is within ``bound`` or there are ``most``.

    The error is the root mean square of the kernel's error over all pairs of check rows, relative to that of the kernel.
    Check rows are rows of the sample that are no landmarks; where the sample has at most ``most`` rows, all of them are landmarks and check rows.
    """
    scaling = {"mean": mean, "scale": scale}
    if kernel == "linear":
        return FeatureMap("linear", columns, **scaling)
    if kernel not in ("rbf", "poly"):
        raise ValueError(f"unknown kernel {kernel!r}")
    if kernel == "poly" and math.comb(len(columns) + degree - 1, degree) <= most:
        return products(columns, gamma, degree, **scaling)
    rows = FeatureMap("linear", columns, **scaling)(sample)
    rows = rows[np.sort(np.unique(rows, axis=0, return_index=True)[1])]
    pool, check = (rows, rows) if len(rows) <= most else (rows[: -min(256, len(rows) // 4)], rows[-min(256, len(rows) // 4) :])
    want = kernel_values(kernel, check, check, gamma, degree)
    m = min(64, most, len(pool))
    while True:
        marks = pool[:m]
        values, vectors = np.linalg.eigh(kernel_values(kernel, marks, marks, gamma, degree))
        kept = values > 1e-10 * max(values[-1], 1e-300)
        projection = vectors[:, kept] / np.sqrt(values[kept])
        found = kernel_values(kernel, check, marks, gamma, degree) @ projection
        error = float(np.sqrt(np.mean((found @ found.T - want) ** 2) / max(np.mean(want**2), 1e-300)))
        if error <= bound or m >= min(most, len(pool)):
            return FeatureMap(kernel, columns, gamma, degree, marks, projection, error=error, **scaling)
        m = min(2 * m, most, len(pool))


# ---------------------------------------------------------------------------------------------
# Models and their sums


@dataclass
class Job:
    """One fit: rows of ``fold`` (all if None) that are not in ``part``; ``name`` is the caller's."""

    name: Hashable
    map: FeatureMap
    cost: float
    fold: Hashable = None
    part: int | None = None
    params: np.ndarray | None = None  # weights and, last, the bias
    start: np.ndarray | None = None  # where the fit starts: params of a model that is near


@dataclass
class Sigmoid:
    """One fit of ``1 / (1 + exp(-(a * margin + b)))`` on margins of models that have not seen the row."""

    name: Hashable
    models: list[Job]  # by part
    fold: Hashable
    targets: tuple[float, float]  # of label 0 and 1
    params: np.ndarray | None = None


def margin_sums(phi: np.ndarray, y: np.ndarray, params: np.ndarray, cost: float, corner: float = CORNER, weight: np.ndarray | None = None) -> np.ndarray:
    """Value, gradient and curvature of the rounded hinge over some rows, as one flat array."""
    z = np.clip((1 - y * (phi @ params[:-1] + params[-1])) / corner, -700, 700)
    s = 1 / (1 + np.exp(-z))
    value = cost * corner * np.logaddexp(0, z)
    slope, bend = -cost * s * y, cost * s * (1 - s) / corner
    if weight is not None:
        value, slope, bend = value * weight, slope * weight, bend * weight
    wide = np.hstack((phi, np.ones((len(phi), 1))))
    half = wide * np.sqrt(bend)[:, None]  # a product with itself takes half the time of one of two matrices
    return np.concatenate(([value.sum()], slope @ wide, (half.T @ half).ravel()))


def sigmoid_sums(margin: np.ndarray, target: np.ndarray, params: np.ndarray) -> np.ndarray:
    u = np.clip(params[0] * margin + params[1], -700, 700)
    p = 1 / (1 + np.exp(-u))
    value = np.logaddexp(0, u) - target * u
    wide = np.stack((margin, np.ones(len(margin))), 1)
    return np.concatenate(([value.sum()], (p - target) @ wide, ((wide * (p * (1 - p))[:, None]).T @ wide).ravel()))


class Newton:
    """Damped steps of one convex fit; ``trial`` is where its sums are wanted next, with the hinge rounded by ``corner``.

    Wide corners come first: far from the optimum a narrow one has no curvature to go by.
    """

    def __init__(self, start: np.ndarray, ridge: np.ndarray, corners: Sequence[float] = (1.0, 0.3, CORNER), tolerance: float = 1e-9) -> None:
        self.at, self.ridge, self.corners, self.tolerance = start, ridge, list(corners), tolerance
        self.trial, self.step, self.length, self.value, self.slope = start, None, 1.0, math.inf, 0.0
        self.done = False

    @property
    def corner(self) -> float:
        return self.corners[0]

    def take(self, sums: np.ndarray) -> None:
        n = len(self.at)
        value = sums[0] + 0.5 * (self.ridge * self.trial**2).sum()
        if self.step is not None and not value <= self.value + 1e-4 * self.length * self.slope + 1e-13 * abs(self.value):
            self.length /= 2
            self.trial = self.at + self.length * self.step
            if self.length < 1e-6:
                self._settle(self.at)
            return
        gradient = sums[1 : n + 1] + self.ridge * self.trial
        curve = sums[n + 1 :].reshape(n, n) + np.diag(self.ridge)
        curve[np.diag_indices(n)] += 1e-10 * (1 + np.trace(curve) / n)
        self.at, self.value, self.length = self.trial, value, 1.0
        self.step = -np.linalg.solve(curve, gradient)
        self.slope = float(gradient @ self.step)
        self.trial = self.at + self.step
        if -self.slope <= (self.tolerance if len(self.corners) == 1 else 1e-3) * (1 + abs(value)):
            self._settle(self.trial)  # so near, the last step needs no test

    def _settle(self, at: np.ndarray) -> None:
        self.at = self.trial = at
        self.step, self.value, self.length = None, math.inf, 1.0
        self.done = len(self.corners) == 1
        self.corners = self.corners[-max(1, len(self.corners) - 1) :]


def start_of(job: Job | Sigmoid) -> Newton:
    if isinstance(job, Sigmoid):
        return Newton(np.array([1.0, 0.0]), np.full(2, 1e-10), (CORNER,))
    n = job.map.width
    ridge = np.concatenate((np.ones(n), [0.0]))
    # The optimum is the same from any start; from one nearby the narrow corner has curvature to go by.
    return Newton(np.zeros(n + 1), ridge) if job.start is None else Newton(job.start, ridge, (CORNER,))


def prepare(df: DataFrame, features: Sequence[str], fold: str | None = None, part: str | None = None) -> DataFrame:
    """Stored training rows ``fold, part, y, x``; without a column for it, the part is a hash of the features.

    They are dealt out evenly to one file for each task that runs at once (``spark.default.parallelism``): a row costs far more
    time than its bytes tell, and every task of a pass sends sums of all models, however few rows it has.
    """
    x = F.array(*[F.col(c).cast("double") for c in features])
    own = F.pmod(F.xxhash64(x), F.lit(PARTS)).cast("long") if part is None else F.col(part).cast("long")
    rows = df.select(F.lit(None).cast("string").alias("fold") if fold is None else F.col(fold).cast("string").alias("fold"), own.alias("part"), F.col("label").cast("double").alias("y"), x.alias("x"))
    return materialize(rows.repartition(df.sparkSession.sparkContext.defaultParallelism), "margin-rows")


def counts_of(rows: DataFrame) -> dict[str | None, tuple[int, int]]:
    """Rows of label 0 and 1 by fold; raises for features or labels that are no numbers."""
    bad = F.col("y").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    found = rows.groupBy("fold").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), F.count_if(bad).alias("bad")).collect()
    if any(r["bad"] for r in found):
        raise ValueError(f"{sum(r['bad'] for r in found)} training rows have a feature or label that is missing or not a number")
    return {r["fold"]: (r["n0"], r["n1"]) for r in found}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of one fold at a time: fold, part, label, features."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x")
        x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        part = batch.column("part").fill_null(-1).to_numpy(zero_copy_only=False)
        folds = batch.column("fold").to_pylist()
        for fold in dict.fromkeys(folds):
            own = np.flatnonzero([f == fold for f in folds])
            for a in range(0, len(own), CHUNK):
                k = own[a : a + CHUNK]
                yield fold, part[k], y[k], x[k]


def _soft(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``log(1 + exp(z))``, its slope and its curvature, from one exponential."""
    e = np.exp(-np.abs(z))
    inverse = 1 / (1 + e)
    return np.maximum(z, 0) + np.log1p(e), np.where(z >= 0, inverse, e * inverse), e * inverse * inverse


@dataclass
class Shared:
    """Models of one fold on plain columns, side by side: their sums are taken over the same columns and products of columns.

    Columns are centred and scaled by ``centre`` and ``spread``. ``turns[k]`` leads from them (and a last one of ones) to the
    features of model ``k``, so a pass is a few matrix products for all models, whatever columns and scaling each of them has.
    """

    columns: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    numbers: list[int]
    turns: list[np.ndarray]

    @staticmethod
    def of(numbered: Sequence[tuple[int, Job]]) -> "Shared":
        columns = np.unique(np.concatenate([j.map.columns for _, j in numbered]))
        place = {c: k for k, c in enumerate(columns)}
        first: dict = {}
        for _, j in numbered:
            if j.map.mean is not None:
                for c, m, v in zip(j.map.columns, j.map.mean, j.map.scale):
                    if v > 0:
                        first.setdefault(c, (m, v))
        centre, spread = (np.array([first.get(c, (0.0, 1.0))[k] for c in columns]) for k in (0, 1))
        turns = []
        for _, j in numbered:
            turn, at, own = np.zeros((len(columns) + 1, j.map.width + 1)), [place[c] for c in j.map.columns], np.arange(j.map.width)
            mean, scale = (np.zeros(j.map.width), np.ones(j.map.width)) if j.map.mean is None else (j.map.mean, j.map.scale)
            ok = scale > 0  # the others are zero
            turn[np.array(at)[ok], own[ok]] = spread[at][ok] / scale[ok]
            turn[-1, own[ok]] = (centre[at] - mean)[ok] / scale[ok]
            turn[-1, -1] = 1.0
            turns.append(turn)
        return Shared(columns, centre, spread, [k for k, _ in numbered], turns)

    def wide(self, x: np.ndarray) -> np.ndarray:
        return np.hstack(((x[:, self.columns] - self.centre) / self.spread, np.ones((len(x), 1))))

    def own(self, k: int, sums: np.ndarray) -> np.ndarray:
        """Sums of the shared columns as sums of the features of model ``k``."""
        turn, n = self.turns[k], len(self.columns) + 1
        curve = np.empty((n, n))
        rows, cols = np.triu_indices(n)
        curve[rows, cols] = curve[cols, rows] = sums[n + 1 :]
        return np.concatenate((sums[:1], sums[1 : n + 1] @ turn, (turn.T @ curve @ turn).ravel()))


def shared_sums(wide: np.ndarray, y: np.ndarray, params: np.ndarray, cost: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """:func:`margin_sums` of all models (columns of ``params``), one row each; of the curvature the upper triangle."""
    a, b = np.triu_indices(wide.shape[1])
    # Arrays from the start: a model that leaves out the part of all rows at hand has sums of zero, as long as any others.
    value, slopes, bends = np.zeros(params.shape[1]), np.zeros(params.T.shape), np.zeros((params.shape[1], len(a)))
    for at in range(0, len(y), step := max(64, min(CELLS // params.shape[1], 4 * CELLS // len(a)))):
        x, sign = wide[at : at + step], y[at : at + step, None]
        soft, slope, bend = _soft((1 - sign * (x @ params)) / corner)
        value, slopes, bends = value + soft.sum(0), slopes + (slope * sign).T @ x, bends + bend.T @ (x[:, a] * x[:, b])
    return np.hstack(((cost * corner * value)[:, None], -cost[:, None] * slopes, (cost / corner)[:, None] * bends))


def shared_sigmoid_sums(wide: np.ndarray, y: np.ndarray, models: np.ndarray, targets: np.ndarray, params: np.ndarray) -> np.ndarray:
    """:func:`sigmoid_sums` of many sigmoids (columns of ``models``, ``targets`` and ``params``), one row each."""
    out = np.zeros((7, models.shape[1]))
    for at in range(0, len(y), step := max(64, CELLS // models.shape[1])):
        margin, one = wide[at : at + step] @ models, y[at : at + step, None] == 1
        target = np.where(one, targets[1], targets[0])
        u = params[0] * margin + params[1]
        value, p, bend = _soft(u)
        off, turned = p - target, bend * margin
        out += [(value - target * u).sum(0), (off * margin).sum(0), off.sum(0), (turned * margin).sum(0), turned.sum(0), turned.sum(0), bend.sum(0)]
    return out.T


def upper(sums: np.ndarray) -> np.ndarray:
    """:func:`margin_sums` without what their curvature repeats below its diagonal."""
    n = math.isqrt(len(sums) - 1)  # of 1 + n + n * n
    rows, cols = np.triu_indices(n)
    return np.concatenate((sums[: n + 1], sums[n + 1 :][rows * n + cols]))


def whole(sums: np.ndarray) -> np.ndarray:
    """The opposite of :func:`upper`."""
    n = (math.isqrt(8 * len(sums) + 1) - 3) // 2  # of 1 + n + n * (n + 1) / 2
    rows, cols = np.triu_indices(n)
    curve = np.empty((n, n))
    curve[rows, cols] = curve[cols, rows] = sums[n + 1 :]
    return np.concatenate((sums[: n + 1], curve.ravel()))


def _map_of(job: Job | Sigmoid) -> FeatureMap:
    return job.map if isinstance(job, Job) else job.models[0].map


def _task_sums(jobs: list[tuple[int, Job | Sigmoid, np.ndarray, float]], shared: Mapping[Hashable, tuple] | None = None, sigmoids: Mapping[Hashable, tuple] | None = None) -> Callable:
    by_fold: dict = {}
    turn: dict = {}
    for each in jobs:
        turn.setdefault(id(_map_of(each[1])), len(turn))
        by_fold.setdefault(each[1].fold, []).append(each)
    for each in by_fold.values():
        each.sort(key=lambda e: turn[id(_map_of(e[1]))])  # those of one map follow each other, so only its features are held
    shared, sigmoids = shared or {}, sigmoids or {}

    def add(wanted: list[tuple], part: np.ndarray, y: np.ndarray, x: np.ndarray, total: dict[int, np.ndarray]) -> None:
        held: list = [None, None]  # a map and its features of these rows

        def features_of(m: FeatureMap) -> np.ndarray:
            if held[0] is not m:
                held[:] = m, None  # the last ones go first
                held[1] = m(x)
            return held[1]

        for number, job, params, corner in wanted:
            if isinstance(job, Sigmoid):
                margin = np.empty(len(y))
                for p, model in enumerate(job.models):
                    own = part == p
                    margin[own] = features_of(model.map)[own] @ model.params[:-1] + model.params[-1]
                sums = sigmoid_sums(margin, np.where(y == 1, job.targets[1], job.targets[0]), params)
            else:
                sums = margin_sums(features_of(job.map), np.where(y == 1, 1.0, -1.0), params, job.cost, corner, None if job.part is None else (part != job.part).astype(float))
            if number in total:
                total[number] += sums
            else:
                total[number] = sums

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        sums_of: dict = {}
        for fold, part, y, x in _chunks(batches):
            for own in dict.fromkeys((fold, None)):
                for where, numbers, leave, params, cost, corner in shared.get(own, []):
                    kept = slice(None) if leave is None else part != leave
                    found = shared_sums(where.wide(x[kept]), np.where(y[kept] == 1, 1.0, -1.0), params, cost, corner)
                    key = own, leave
                    sums_of[key] = (numbers, sums_of[key][1] + found if key in sums_of else found)
                if own in sigmoids:
                    where, numbers, models, targets, params = sigmoids[own]
                    for p, weights in enumerate(models):
                        kept = part == p
                        found = shared_sigmoid_sums(where.wide(x[kept]), y[kept], weights, targets, params)
                        key = own, "sigmoid"
                        sums_of[key] = (numbers, sums_of[key][1] + found if key in sums_of else found)
            wanted = [*by_fold.get(fold, []), *(by_fold.get(None, []) if fold is not None else [])]
            step = max(64, HELD // max((_map_of(job).width + 1 for _, job, _, _ in wanted), default=1))
            for at in range(0, len(y) if wanted else 0, step):
                add(wanted, part[at : at + step], y[at : at + step], x[at : at + step], total)
        for numbers, found in sums_of.values():
            yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["job", "sums"])
        for number in list(total):  # one at a time: wide models have sums of a quarter MB each
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([upper(total.pop(number)).tobytes()], pa.binary())], ["job", "sums"])

    return task


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows ``job, sums`` by job; ``sums`` are doubles. Beside the sums one batch is held, and no copy of it."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for job, sums in zip(batch.column("job").to_pylist(), batch.column("sums")):
            x = np.frombuffer(sums.as_buffer())
            if job in total:
                total[job] += x
            else:
                total[job] = x.copy()
    for job in list(total):
        yield pa.record_batch([pa.array([job], pa.int64()), pa.array([total.pop(job).tobytes()], pa.binary())], ["job", "sums"])


def minimise(rows: DataFrame, jobs: Sequence[Job | Sigmoid], max_iter: int = 60) -> int:
    """Fit all ``jobs`` on the stored ``rows``; sets their ``params`` and returns the number of passes.

    All that have not settled share a pass, as long as their sums take ``PASS_BYTES`` at most; so passes do not
    multiply with models until memory does. However many splits the stored rows have, at most ``4 * spark.default.parallelism``
    tasks send sums, so those of a model that meet in one task stay bounded.
    """
    rows = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    passes, size = 0, lambda n: 8 * (1 + n + n * n)
    steps = [start_of(j) for j in jobs]
    plain: dict = {}
    for k, j in enumerate(jobs):
        first = j if isinstance(j, Job) else j.models[0]
        if first.map.kernel == "linear" and (first is j or all(m.map is first.map for m in j.models)):
            plain.setdefault((j.fold, first is j), []).append((k, first))
    together = {key: Shared.of(own) for key, own in plain.items()}
    together = {key: t for key, t in together.items() if len(t.columns) <= WIDE}
    place = {k: (t, at) for t in together.values() for at, k in enumerate(t.numbers)}
    waves, room = [[]], PASS_BYTES
    for k, s in enumerate(steps):
        need = size(len(s.at)) if k not in place or isinstance(jobs[k], Sigmoid) else size(len(place[k][0].columns) + 1)
        if waves[-1] and need > room:
            waves.append([])
            room = PASS_BYTES
        waves[-1].append(k)
        room -= need
    for wave in waves:
        for _ in range(max_iter):
            todo = [k for k in wave if not steps[k].done]
            if not todo:
                break
            grouped: dict = {}
            for k in todo:
                if k in place:
                    grouped.setdefault((jobs[k].fold, jobs[k].part if isinstance(jobs[k], Job) else "sigmoid"), []).append(k)
            shared, sigmoids = {}, {}
            for (fold, part), ks in grouped.items():
                t = together[fold, part != "sigmoid"]
                table = Shared(t.columns, t.centre, t.spread, [], [])
                if part == "sigmoid":
                    models = [np.stack([t.turns[place[k][1]] @ jobs[k].models[p].params for k in ks], 1) for p in range(len(jobs[ks[0]].models))]
                    sigmoids[fold] = table, ks, models, np.array([jobs[k].targets for k in ks]).T, np.array([steps[k].trial for k in ks]).T
                    continue
                params = np.stack([t.turns[place[k][1]] @ steps[k].trial for k in ks], 1)
                shared.setdefault(fold, []).append((table, ks, part, params, np.array([jobs[k].cost for k in ks]), np.array([steps[k].corner for k in ks])))
            parts = rows.mapInArrow(_task_sums([(k, jobs[k], steps[k].trial, steps[k].corner) for k in todo if k not in place], shared, sigmoids), "job long, sums binary")
            found = parts.repartition(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(todo)), "job").mapInArrow(add_up, "job long, sums binary").collect()
            passes += 1
            got = {r["job"]: np.frombuffer(r["sums"]) for r in found}
            for k in todo:
                if k not in got:
                    raise ValueError(f"no training rows for {jobs[k].name!r}")
                steps[k].take(whole(got[k]) if k not in place else got[k] if isinstance(jobs[k], Sigmoid) else place[k][0].own(place[k][1], got[k]))
    for job, s in zip(jobs, steps):
        job.params = s.at
    return passes


def fit_here(phi: np.ndarray, y: np.ndarray, cost: float, max_iter: int = 60) -> np.ndarray:
    """The same fit on rows in memory."""
    step = Newton(np.zeros(phi.shape[1] + 1), np.concatenate((np.ones(phi.shape[1]), [0.0])))
    for _ in range(max_iter):
        if step.done:
            break
        step.take(margin_sums(phi, np.where(y == 1, 1.0, -1.0), step.trial, cost, step.corner))
    return step.at


# ---------------------------------------------------------------------------------------------
# Fitted models


@dataclass
class MarginModel:
    """A fitted classifier: columns by name, features of the kernel, weights with the bias last, sigmoid of the probability."""

    features: list[str]
    map: FeatureMap
    params: np.ndarray
    sigmoid: tuple[float, float] | None = None
    passes: int = 0

    @property
    def kernel_error(self) -> float:
        return self.map.error

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.params[:-1] + self.params[-1]

    def rate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        margin = self.margins(x)
        if self.sigmoid is None:
            return margin, None
        return margin, 1 / (1 + np.exp(-np.clip(self.sigmoid[0] * margin + self.sigmoid[1], -700, 700)))


def sample_rows(rows: DataFrame, most: int, seed: int) -> dict[str | None, np.ndarray]:
    """At most ``most`` training rows of every fold, by a seeded hash."""
    keyed = rows.withColumn("key", F.xxhash64("x"))
    picked = take_random(keyed.na.fill({"fold": ""}), ["fold"], seed, ["key"], F.lit(most)).select("fold", "x").collect()
    out: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: r["x"]):
        out.setdefault(r["fold"], []).append(r["x"])
    order = lambda x: np.random.default_rng(seed).permutation(len(x))
    return {fold or None: np.array(x)[order(x)] for fold, x in out.items()}


@dataclass
class Wanted:
    """A model to fit: its place in the caller's table, columns, kernel and cost."""

    name: Hashable
    columns: Sequence[str]
    c: float = 1.0
    kernel: str = "rbf"
    gamma: float | None = None
    degree: int = 3
    fold: str | None = None
    leave: int | None = None
    options: dict = field(default_factory=dict)


def scale_gammas(rows: DataFrame, width: int) -> dict[str | None, Callable[[Sequence[int]], float]]:
    """By fold: ``1 / (n_features * variance of all entries)`` of some columns, from one pass of sums."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(width)] + [F.sum(F.col("x")[k] ** 2).alias(f"q{k}") for k in range(width)]
    out = {}
    for r in rows.groupBy("fold").agg(*aggs).collect():
        def gamma(columns: Sequence[int], r=r) -> float:
            n = r["n"] * len(columns)
            mean = sum(r[f"s{k}"] for k in columns) / n
            var = sum(r[f"q{k}"] for k in columns) / n - mean * mean
            return 1.0 / (len(columns) * var) if var > 0 else 1.0 / len(columns)

        out[r["fold"]] = gamma
    return out


def fit_many(
    rows: DataFrame, features: Sequence[str], wanted: Sequence[Wanted], probability: bool = True, n_components: int = 256, error_bound: float = 0.05, max_iter: int = 60, seed: int = 42
) -> dict[Hashable, MarginModel]:
    """Fit all ``wanted`` models on rows of :func:`prepare` together.

    ``probability``: five more fits for each model, every one without one part of the rows, give each row a margin
    from a model that has not seen it; the sigmoid is fitted on those, with Platt's targets.
    """
    counts = counts_of(rows)
    place = {f: k for k, f in enumerate(features)}
    needs_rows = any(w.kernel != "linear" for w in wanted)
    samples = sample_rows(rows, 2 * n_components, seed) if needs_rows else {}
    gammas = scale_gammas(rows, len(features)) if any(w.kernel != "linear" and w.gamma is None for w in wanted) else {}
    maps: dict = {}
    jobs: list[Job] = []
    for w in wanted:
        columns = np.array([place[c] for c in w.columns])
        gamma = w.gamma if w.gamma is not None else gammas[w.fold](columns) if w.kernel != "linear" else 1.0
        key = (w.kernel, tuple(columns), gamma, w.degree, w.fold)
        if key not in maps:
            maps[key] = kernel_map(w.kernel, columns, gamma, w.degree, samples.get(w.fold, np.zeros((0, len(features)))), n_components, error_bound)
        jobs.append(Job(w.name, maps[key], w.c, w.fold, w.leave))
    if not probability:
        passes = minimise(rows, jobs, max_iter)
        return {w.name: MarginModel([features[k] for k in j.map.columns], _own_columns(j.map), j.params, None, passes) for w, j in zip(wanted, jobs)}
    passes = minimise(rows, jobs, max_iter)
    # A model without a part of the rows is near the one of all rows, and settles in a few passes from there.
    parts = [[Job((w.name, p), j.map, j.cost, j.fold, p, start=j.params) for p in range(PARTS)] for w, j in zip(wanted, jobs)]
    passes += minimise(rows, list(itertools.chain(*parts)), max_iter)
    sigmoids = []
    for w, without in zip(wanted, parts):
        n0, n1 = counts[w.fold] if w.fold in counts else tuple(map(sum, zip(*counts.values())))
        sigmoids.append(Sigmoid(w.name, without, w.fold, (1 / (n0 + 2), (n1 + 1) / (n1 + 2))))
    passes += minimise(rows, sigmoids, max_iter)
    return {w.name: MarginModel([features[k] for k in j.map.columns], _own_columns(j.map), j.params, tuple(map(float, s.params)), passes) for w, j, s in zip(wanted, jobs, sigmoids)}


def _own_columns(m: FeatureMap) -> FeatureMap:
    """The same map over an array of its own columns alone."""
    return FeatureMap(**{**vars(m), "columns": np.arange(len(m.columns))})


def rated(df: DataFrame, models: dict[str | None, MarginModel], fold: str | None = None) -> DataFrame:
    """``df`` with ``prediction`` and ``score`` by the model of the row's fold; null where there is none or a feature is missing."""
    features = next(iter(models.values())).features
    if any(m.features != features for m in models.values()):
        raise ValueError("models of one table have the same columns")
    sent = df.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf(T.StructType([T.StructField("prediction", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    def rate(key: pa.Array, x: pa.Array) -> pa.Array:
        table = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), -1)
        prediction, score = np.full(len(x), np.nan), np.full(len(x), np.nan)
        keys = key.to_pylist()
        for k in dict.fromkeys(keys):
            own = np.flatnonzero([v == k for v in keys])
            if k in sent.value:
                margin, p = sent.value[k].rate(table[own])
                prediction[own] = np.where(np.isnan(margin), np.nan, margin > 0)
                score[own] = np.nan if p is None else p
        return pa.StructArray.from_arrays([pa.array(v, t, from_pandas=True) for v, t in ((prediction, pa.int32()), (score, pa.float64()))], ["prediction", "score"])

    key = F.lit(None).cast("string") if fold is None else F.col(fold).cast("string")
    out = df.withColumn("_rated", rate(key, F.array(*[F.col(c).cast("double") for c in features])))
    kept = [c for c in df.columns if c not in ("prediction", "score")]
    return out.select(*kept, F.col("_rated.prediction").alias("prediction"), F.col("_rated.score").alias("score"))


def count_cells(rows: DataFrame, models: dict[Hashable, tuple[Hashable, int | None, MarginModel]]) -> DataFrame:
    """``model, tn, fp, fn, tp`` (``model`` numbers them in order) on prepared rows, all models in one pass.

    Each model comes with the fold whose rows it rates (None: all) and the part of them (None: all).
    """
    sent = rows.sparkSession.sparkContext.broadcast(list(models.values()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent.value), 4), np.int64)
        for fold, part, y, x in _chunks(batches):
            for k, (own, leave, model) in enumerate(sent.value):
                if own is None or own == fold:
                    kept = np.ones(len(y), bool) if leave is None else part == leave
                    total[k] += np.bincount(2 * (y[kept] == 1) + (model.margins(x[kept]) > 0), minlength=4)
        yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), *[pa.array(total[:, c]) for c in range(4)]], ["model", "tn", "fp", "fn", "tp"])

    parts = rows.mapInArrow(task, "model int, tn long, fp long, fn long, tp long")
    return parts.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def rate_by_all(rows: DataFrame, features: Sequence[str], models: Sequence[tuple[Hashable, Hashable, MarginModel]]) -> DataFrame:
    """``model, y, prediction, score`` of every prepared row by every model of its fold; ``model`` numbers them in order."""
    place = {f: k for k, f in enumerate(features)}
    by_fold: dict = {}
    for k, (_, fold, model) in enumerate(models):
        by_fold.setdefault(fold, []).append((k, np.array([place[c] for c in model.features]), model))
    sent = rows.sparkSession.sparkContext.broadcast(by_fold)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, _, y, x in _chunks(batches):
            for k, columns, model in sent.value.get(fold, []):
                margin, score = model.rate(x[:, columns])
                score = pa.nulls(len(y), pa.float64()) if score is None else pa.array(score)
                yield pa.record_batch([pa.array(np.full(len(y), k), pa.int32()), pa.array(y), pa.array((margin > 0).astype(np.int32)), score], ["model", "y", "prediction", "score"])

    return rows.mapInArrow(task, "model int, y double, prediction int, score double")


def dumps(model: MarginModel) -> bytes:
    return pickle.dumps((model.features, vars(model.map), model.params, model.sigmoid))


def loads(data: bytes) -> MarginModel:
    features, m, params, sigmoid = pickle.loads(data)
    return MarginModel(features, FeatureMap(**m), params, sigmoid)
