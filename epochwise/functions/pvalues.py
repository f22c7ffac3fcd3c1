"""p-values for results that have one row per variable or frequency.

Counts, means and rank sums are computed by Spark; only the final number of each row is here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz method)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def student_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of ``[[a, b], [c, d]]``: all tables at most as likely as the observed one."""
    r1, c1, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)

    def logp(k: int) -> float:
        return sum(
            math.lgamma(top + 1) - math.lgamma(part + 1) - math.lgamma(top - part + 1)
            for top, part in ((c1, k), (n - c1, r1 - k))
        ) - (math.lgamma(n + 1) - math.lgamma(r1 + 1) - math.lgamma(n - r1 + 1))

    limit = logp(a) + 1e-7
    mode = min(max((r1 + 1) * (c1 + 1) // (n + 2), lo), hi)

    def edge(inside: int, outside: int) -> int | None:
        """Value nearest to the mode on one side whose table is rare enough."""
        if logp(outside) > limit:
            return None
        while abs(inside - outside) > 1:
            mid = (inside + outside) // 2
            inside, outside = (mid, outside) if logp(mid) > limit else (inside, mid)
        return outside

    if logp(mode) <= limit:
        return 1.0
    total = 0.0
    for start, stop, step in ((edge(mode, lo), lo - 1, -1), (edge(mode, hi), hi + 1, 1)):
        if start is None:
            continue
        for k in range(start, stop, step):
            term = math.exp(logp(k))
            total += term
            if term < 1e-18 * max(total, 1e-300):
                break
    return min(total, 1.0)


def rank_sum_two_sided(n1: float, n0: float, rank_sum: float, sizes: Sequence[float] = ()) -> float:
    """Twice the smaller tail of the exact distribution of the first set's rank sum, at most 1.

    ``sizes``: how many values are equal, from the lowest value on; the distribution is the one of all choices of ``n1`` of
    these ranks. Without sizes all values differ.
    """
    n1, n0 = int(n1), int(n0)
    if not len(sizes):
        # The sum over the least possible one is that of a partition into at most ``few`` parts of at most ``many``.
        few, many = min(n1, n0), max(n1, n0)
        over = int(round(rank_sum - n1 * (n1 + 1) / 2))
        over = min(over, n1 * n0 - over)
        ways = np.zeros(n1 * n0 + 1)
        ways[0] = 1.0
        for i in range(1, few + 1):
            for r in range(i):  # times 1 / (1 - q^i)
                ways[r::i] = np.cumsum(ways[r::i])
            ways[many + i:] -= ways[:-(many + i)].copy() if many + i < len(ways) else 0.0  # times 1 - q^(many + i)
        return min(1.0, 2.0 * float(ways[:over + 1].sum() / math.comb(n1 + n0, n1)))
    doubled, below = [], 0
    for t in (int(x) for x in sizes):
        doubled += [2 * below + t + 1] * t
        below += t
    ways: list[dict[int, int]] = [{0: 1}] + [{} for _ in range(n1)]
    for r in doubled:
        for k in range(n1, 0, -1):
            for total, count in ways[k - 1].items():
                ways[k][total + r] = ways[k].get(total + r, 0) + count
    seen = round(2 * rank_sum)
    low, high = (sum(c for t, c in ways[n1].items() if ok(t)) for ok in (lambda t: t <= seen, lambda t: t >= seen))
    return min(1.0, 2.0 * min(low, high) / math.comb(len(doubled), n1))


def _per_row(fn):
    """Arrow UDF that applies ``fn`` to each of a few result rows; a missing argument gives null."""

    def run(*cols: pd.Series) -> pd.Series:
        rows = (None if any(pd.isna(x) for x in r) else fn(*r) for r in zip(*cols))
        return pd.Series(list(rows), dtype="float64")

    return F.pandas_udf(run, "double")


def normal_p(z: str) -> Column:
    return _per_row(normal_two_sided)(z)


def rank_sum_p(n1: str, n0: str, rank_sum: str, sizes: str) -> Column:
    def run(n1: pd.Series, n0: pd.Series, w: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else rank_sum_two_sided(a, b, c, x) for a, b, c, x in zip(n1, n0, w, sizes)], dtype="float64")

    return F.pandas_udf(run, "double")(n1, n0, rank_sum, sizes)


def student_p(t: str, dof: str) -> Column:
    return _per_row(student_two_sided)(t, dof)


def fisher_p(a: str, b: str, c: str, d: str) -> Column:
    return _per_row(fisher_two_sided)(a, b, c, d)
