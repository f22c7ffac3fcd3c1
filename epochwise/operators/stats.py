"""Group differences: mean and median spectra, AUROC with bootstrap, rank and t tests, cohort tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochwise.functions.pvalues import fisher_p, normal_p, rank_sum_p, student_p
from epochwise.operators.ordered import bounded_chunks, cumulative, percentiles, take_random
from epochwise.session import materialize, spread


def mean_spectrum(spectra: DataFrame, by: Sequence[str] = ("set",), metric: str = "std") -> DataFrame:
    """Mean per frequency with population standard deviation or standard error."""
    spread = F.stddev_pop("psd")
    if metric == "sem":
        spread = spread / F.sqrt(F.count("psd"))
    elif metric != "std":
        raise ValueError("the spread is std or sem")
    if spectra.isEmpty():
        raise ValueError("there are no spectra to average")
    return spectra.groupBy(*by, "freq_hz").agg(F.avg("psd").alias("mean"), spread.alias(metric), F.count("psd").alias("n"))


def median_spectrum(spectra: DataFrame, by: Sequence[str] = ("set",)) -> DataFrame:
    """Median and median absolute deviation per frequency, and both band edges in dB."""
    keys = [*by, "freq_hz"]
    med = percentiles(spectra, keys, "psd", {"median": 0.5})
    off = spectra.join(med, keys).withColumn("_d", F.abs(F.col("psd") - F.col("median")))
    mad = percentiles(off, keys, "_d", {"mad": 0.5})

    def db(x: Column) -> Column:
        return F.when(x > 0, 10 * F.log10(x))

    m, d = F.col("median"), F.col("mad")
    return med.join(mad, keys).select(*keys, "median", "mad", db(m).alias("median_db"), db(m + d).alias("upper_db"), db(m - d).alias("lower_db"))


def set_pairs(spectra: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows tagged with each pair of sets they belong to; ``label`` is 1 for the first of the pair.

    Every row is repeated once per other set (two times for three sets); nothing is joined.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    table = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    mine = F.filter(table, lambda p: (p.a == F.col("set")) | (p.b == F.col("set")))
    return spectra.withColumn("_p", F.explode(mine)).select(
        F.col("_p.pair").alias("pair"), *spectra.columns, (F.col("_p.a") == F.col("set")).cast("int").alias("label")
    )


def equal_sized_sets(epochs: DataFrame, by: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The larger set of each pair reduced at random to the size of the smaller one."""
    once = epochs.select(*by, "label", *keys).distinct()
    sizes = once.groupBy(*by).agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("_k"))
    return take_random(once.join(sizes, list(by)), [*by, "label"], seed, list(keys), F.col("_k")).drop("_k")


LEAF = 256  # positions whose draws are told apart one by one: a random byte is a position


def draws_between(n: int, cuts: np.ndarray, replicates: int, seed: int, salt: int) -> np.ndarray:
    """How often each replicate of ``n`` draws from positions ``0 .. n - 1`` hits each stretch ``cuts[i]`` to ``cuts[i + 1]``.

    All positions halve down a tree, at multiples of ``LEAF``; at a node the draws of every replicate are split between the halves
    by a binomial, seeded by the node. So a replicate has ``n`` draws exactly, and stretches drawn in different tasks, however
    the positions are dealt to them, belong to one and the same multinomial draw. Only nodes that a cut goes through are split.
    """
    edges, place = np.unique(cuts, return_inverse=True)
    if len(edges) < len(cuts):  # stretches without positions are not drawn
        drawn = draws_between(n, edges, replicates, seed, salt) if len(edges) > 1 else np.zeros((1, replicates))
        return np.where(np.diff(cuts)[:, None] > 0, drawn[np.minimum(place[:-1], len(drawn) - 1)], 0)
    out = np.zeros((replicates, len(cuts) - 1))
    key = [seed % (1 << 64), salt]

    # A list and no recursion: a function that names itself is a cycle, which would keep every call's arrays until Python looks for cycles.
    nodes = [(0, n, np.full(replicates, n))] if n else []
    while nodes:
        a, b, drawn = nodes.pop()
        low, high = np.searchsorted(cuts, a, "right"), np.searchsorted(cuts, b, "left")
        if low == high:  # no cut inside: all draws are of one stretch
            if 0 < low < len(cuts):
                out[:, low - 1] += drawn
            continue
        rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence([*key, a, b])))
        if b - a > LEAF:
            middle = a + -(-(b - a) // (2 * LEAF)) * LEAF
            left = rng.binomial(drawn, (middle - a) / (b - a))
            nodes += [(middle, b, drawn - left), (a, middle, left)]
            continue
        width, first, last = high - low + 1, max(low - 1, 0), min(high, len(cuts) - 1)
        ends = np.concatenate(([0], np.cumsum(drawn)))
        bits = rng.bit_generator.random_raw(-(-int(ends[-1]) // 8)).tobytes() if b - a == LEAF else rng.integers(0, b - a, ends[-1], np.uint8).tobytes()
        stretch = np.searchsorted(cuts, a + np.arange(LEAF), "right") - low  # 0 is the stretch before the first cut inside
        hit = np.frombuffer(bits.translate(np.minimum(stretch, high - low).astype(np.uint8).tobytes()), np.uint8)
        for at in range(0, replicates, 512):  # what is counted at once stays in the cache
            some = drawn[at:at + 512]
            where = np.repeat(np.arange(len(some)) * width, some)
            where += hit[ends[at]:ends[at + len(some)]]
            out[at:at + len(some), first:last] += np.bincount(where, minlength=width * len(some)).reshape(-1, width)[:, first - low + 1 : last - low + 1]
    return out.T


def win_stretches(n1: np.ndarray, n0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of both sets by stretches of ascending values, and how much of a stretch's own second set does not lie below its first set.

    In a stretch all values of the second set come before those of the first (0), or it is one value that both sets have (a half). Which
    value of a stretch a draw hits makes no difference to the wins.
    """
    tied = (n1 > 0) & (n0 > 0)
    opens = tied.copy()
    opens[1:] |= tied[:-1] | ((n0[1:] > 0) & (n1[:-1] > 0))
    opens[:1] = True
    at = np.flatnonzero(opens)
    return np.add.reduceat(n1, at), np.add.reduceat(n0, at), 0.5 * tied[at]


RANGES = 1024  # value ranges in all, each with three numbers a replicate; a group has one at least


def auroc_bootstrap(
    rows: DataFrame, by: Sequence[str], value: str = "psd", replicates: int = 10_000, seed: int = 42, rows_per_chunk: int = 20_000
) -> DataFrame:
    """AUROC (first set above second, ties half) per group with a percentile bootstrap interval.

    Every replicate draws as many rows from each set as the set has, with replacement (:func:`draws_between`); equal
    values are counted before any exchange. Value ranges of at least ``rows_per_chunk`` rows, about ``RANGES`` at most, are worked off
    on their own, a slab of values for all replicates at once. Neighbouring ranges are then chained, level by level with a bounded number
    of ranges per step; what is chained grows with replicates, not with rows.
    """
    by = list(by)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")
    )
    counted = materialize(counted, "values")
    chunked, levels = bounded_chunks(counted, by, "v", max(rows_per_chunk, -(-counted.count() // RANGES)))
    # One row a range: how many rows of each set lie in lower ranges, and in all.
    sizes = chunked.groupBy(*by, *levels).agg(F.sum("n1").alias("_s1"), F.sum("n0").alias("_s0"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy(*levels).rowsBetween(W.unboundedPreceding, -1)
    places = sizes.select(*by, *levels, *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_off{k}") for k in (1, 0)], *[F.sum(f"_s{k}").over(group).alias(f"_all{k}") for k in (1, 0)])
    chunked = chunked.join(places, [*by, *levels]).withColumn("_seed", F.xxhash64(F.lit(seed), *by))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chunked.schema.fields if f.name in by)

    def part_schema(inner: list[str]) -> str:
        return schema + "".join(f"{c} int, " for c in inner) + "p array<double>, n array<double>, u array<double>"

    def one_range(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Column 0 holds the data as observed, the others the replicates.
        p, n, u = (np.zeros(replicates + 1) for _ in range(3))
        head = pdf.iloc[0]
        pdf = pdf.sort_values("v")
        n1, n0, own = win_stretches(pdf["n1"].to_numpy(), pdf["n0"].to_numpy())
        p[0], n[0], u[0] = n1.sum(), n0.sum(), (n1 * (np.cumsum(n0) - own * n0)).sum()
        cuts = {k: int(head[f"_off{k}"]) + np.concatenate(([0], np.cumsum(x))) for k, x in ((1, n1), (0, n0))}
        slab = max(1, 4_000_000 // replicates)
        for at in range(0, len(own), slab):
            part = own[at:at + slab]
            w1, w0 = (draws_between(int(head[f"_all{k}"]), cuts[k][at:at + len(part) + 1], replicates, int(head["_seed"]), k).T for k in (1, 0))
            below = np.cumsum(w0, axis=1)
            won, lost = w1.sum(axis=1), below[:, -1].copy()
            w0 *= part
            below -= w0
            u[1:] += np.einsum("rs,rs->r", w1, below) + won * n[1:]
            p[1:] += won
            n[1:] += lost
        return pd.DataFrame([{**dict(zip([*by, *levels], key)), "p": p, "n": n, "u": u}])

    def chained(pdf: pd.DataFrame, level: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of consecutive ranges: rows of the first set also win against everything below their range."""
        pdf = pdf.sort_values(level)
        p, n, u = (np.stack(pdf[c].to_numpy()) for c in ("p", "n", "u"))
        return p.sum(axis=0), n.sum(axis=0), (u + p * (np.cumsum(n, axis=0) - n)).sum(axis=0)

    def chain(level: str, outer: list[str]):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            p, n, u = chained(pdf, level)
            return pd.DataFrame([{**dict(zip([*by, *outer], key)), "p": p, "n": n, "u": u}])

        return run

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, n, u = chained(pdf, levels[0])
        with np.errstate(invalid="ignore", divide="ignore"):
            auc = u / (p * n)
        draws = auc[1:][np.isfinite(auc[1:])]
        lo, hi = np.percentile(draws, [2.5, 97.5]) if len(draws) else (None, None)
        return pd.DataFrame([{**dict(zip(by, key)), "auroc": auc[0] if np.isfinite(auc[0]) else None, "ci_low": lo, "ci_high": hi}])

    parts = spread(chunked, *by, *levels).groupBy(*by, *levels).applyInPandas(one_range, part_schema(levels))
    for i in range(len(levels) - 1, 0, -1):
        outer = levels[:i]
        parts = parts.groupBy(*by, *outer).applyInPandas(chain(levels[i], outer), part_schema(outer))
    res = parts.groupBy(*by).applyInPandas(finish, f"{schema}auroc double, ci_low double, ci_high double")
    strong = (F.col("auroc") >= 0.7) | (F.col("auroc") <= 0.3)
    sided = (F.col("ci_low") > 0.5) | (F.col("ci_high") < 0.5)
    return res.withColumn("strong", strong).withColumn("significant", sided)


def rank_sum(rows: DataFrame, by: Sequence[str], value: str, exact: str = "small") -> DataFrame:
    """Rank sum of the first set, its standardised value (tie and continuity corrected) and two-sided p.

    Small sets have the exact p, twice the smaller tail: ``small``, where the smaller set has less than 10 and both less than
    20 values, given the ties as they are; ``untied``, where a set has at most 8 values and none are equal (as long as the product
    of both sizes is at most 4,000,000); ``never``. All others take the normal approximation.
    """
    if exact not in ("small", "untied", "never"):
        raise ValueError(f"unknown choice of exact tests {exact!r}")
    c = cumulative(rows, by, value, {"n": F.count(F.lit(1)), "p": F.sum(F.col("label").cast("long"))})
    n = F.col("n").cast("double")
    # At most 19 entries: larger groups list nothing.
    sizes = F.transform(F.array_sort(F.collect_list(F.when(F.col("n_total") < 20, F.struct("n_below", "n")))), lambda x: x.n.cast("double"))
    agg = c.groupBy(*by).agg(
        F.max("p_total").cast("double").alias("n1"), (F.max("n_total") - F.max("p_total")).cast("double").alias("n0"),
        F.sum(F.col("p") * (F.col("n_below") + (n + 1) / 2)).alias("w"), F.sum(n * n * n - n).alias("_ties"), sizes.alias("_sizes"),
    )
    total = F.col("n1") + F.col("n0")
    mean = F.col("n1") * (total + 1) / 2
    var = F.col("n1") * F.col("n0") / 12 * (total + 1 - F.try_divide(F.col("_ties"), total * (total - 1)))
    off = F.col("w") - mean
    z = F.try_divide(off - 0.5 * F.signum(off), F.sqrt(F.greatest(var, F.lit(0.0))))
    least = F.least("n1", "n0")
    counted = {
        "small": (least < 10) & (total < 20), "untied": (least <= 8) & (F.col("_ties") == 0) & (F.col("n1") * F.col("n0") <= 4_000_000), "never": F.lit(False),
    }[exact] & (least > 0)
    out = agg.select(*by, "n1", "n0", F.col("w").alias("rank_sum"), z.alias("z"), F.when(counted, F.col("_sizes") if exact == "small" else F.array().cast("array<double>")).alias("_sizes"))
    p = F.when(F.col("_sizes").isNotNull(), rank_sum_p("n1", "n0", "rank_sum", "_sizes")).otherwise(normal_p("z"))
    return out.withColumn("p_value", p).drop("_sizes")


def _long(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), list(columns), name, "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def _welch(m1: Column, v1: Column, n1: Column, m0: Column, v0: Column, n0: Column) -> tuple[Column, Column]:
    s1, s0 = F.try_divide(v1, n1), F.try_divide(v0, n0)
    t = F.try_divide(m1 - m0, F.sqrt(s1 + s0))
    dof = F.try_divide((s1 + s0) * (s1 + s0), F.try_divide(s1 * s1, n1 - 1) + F.try_divide(s0 * s0, n0 - 1))
    return t, dof


def _two_groups(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Mean, sample variance and count per variable and group, from one pass without repeating rows."""
    packed = []
    for c in columns:
        x = F.col(c).cast("double")
        fields = [F.lit(c).alias(name)]
        for g in (1, 0):
            mine = F.when((F.col("label") == g) & ~F.isnan(x), x)
            fields += [F.avg(mine).alias(f"m{g}"), F.var_samp(mine).alias(f"v{g}"), F.count(mine).cast("double").alias(f"n{g}")]
        packed.append(F.struct(*fields))
    return df.agg(F.array(*packed).alias("_a")).select(F.explode("_a").alias("_g")).select("_g.*")


def feature_differences(df: DataFrame, columns: Sequence[str], test: str = "t-test") -> DataFrame:
    """Per feature the means of both classes, their difference, p-value and Cohen's d, sorted by p.

    ``label`` is 1 for the first and 0 for the second set.
    """
    if test not in ("t-test", "mannwhitney"):
        raise ValueError("the test is t-test or mannwhitney")
    g = _two_groups(df, columns, "feature")
    c = {n: F.col(n) for n in ("m1", "v1", "n1", "m0", "v0", "n0")}
    t, dof = _welch(**{k: c[k] for k in ("m1", "v1", "n1", "m0", "v0", "n0")})
    pooled = F.sqrt(F.try_divide((c["n1"] - 1) * c["v1"] + (c["n0"] - 1) * c["v0"], c["n1"] + c["n0"] - 2))
    out = g.select(
        "feature", c["m1"].alias("mean_1"), c["m0"].alias("mean_0"), (c["m1"] - c["m0"]).alias("mean_diff"),
        t.alias("_t"), dof.alias("_dof"), F.when(pooled > 0, (c["m1"] - c["m0"]) / pooled).alias("cohen_d"),
    )
    if test == "t-test":
        out = out.withColumn("statistic", F.col("_t")).withColumn("p_value", student_p("_t", "_dof"))
    else:
        r = rank_sum(_long(df, ["label"], columns, "feature"), ["feature"], "value", "untied").select("feature", F.col("rank_sum").alias("statistic"), "p_value")
        out = out.join(r, "feature").withColumn("cohen_d", F.lit(None).cast("double"))
    cols = ["feature", "mean_1", "mean_0", "mean_diff", "statistic", "p_value", "cohen_d"]
    return out.select(*cols).orderBy(F.col("p_value").asc_nulls_last(), "feature")


def _with_group(metadata: DataFrame, cases: DataFrame, case: str) -> DataFrame:
    """Rows of listed cases appear twice: as outliers (1) and as part of all cases (0)."""
    ids = cases.select(F.col(case).cast("string").alias("_id")).distinct().withColumn("_hit", F.lit(1))
    flagged = metadata.withColumn("_id", F.col(case).cast("string")).join(ids, "_id", "left")
    groups = F.when(F.col("_hit") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return flagged.withColumn("label", F.explode(groups))


def outlier_means(metadata: DataFrame, cases: DataFrame, columns: Sequence[str], binary: Sequence[str], case: str = "case_id") -> DataFrame:
    """Mean per variable among the outlier cases and among all cases."""
    g = _two_groups(_with_group(metadata, cases, case), columns, "variable")
    kind = F.when(F.col("variable").isin(*binary), "binary").otherwise("numeric") if binary else F.lit("numeric")
    return g.select("variable", kind.alias("type"), F.col("m1").alias("outlier_mean"), F.col("m0").alias("full_mean"),
                    (F.col("m1") - F.col("m0")).alias("difference"))


def outlier_tests(metadata: DataFrame, cases: DataFrame, columns: Sequence[str], case: str = "case_id") -> DataFrame:
    """Fisher's exact test for 0/1 variables, Welch's t-test for others; rounded to 4 decimals."""
    grouped = _with_group(metadata, cases, case)
    long = _long(grouped, ["label"], columns, "variable")
    ones = [F.count_if((F.col("label") == g) & (F.col("value") == x)).alias(f"c{g}{x}") for g in (1, 0) for x in (0, 1)]
    full = F.col("label") == 0
    binary = F.bool_and(F.when(full, F.col("value").isin(0.0, 1.0))) & (F.countDistinct(F.when(full & F.col("value").isin(0.0, 1.0), F.col("value"))) == 2)
    counts = long.groupBy("variable").agg(*ones, binary.alias("binary"))
    g = _two_groups(grouped, columns, "variable").join(counts, "variable")
    t, dof = _welch(F.col("m1"), F.col("v1"), F.col("n1"), F.col("m0"), F.col("v0"), F.col("n0"))
    g = g.withColumn("_t", t).withColumn("_dof", dof)
    p = F.when(F.col("binary"), fisher_p("c11", "c10", "c01", "c00")).otherwise(student_p("_t", "_dof"))
    return g.select(
        "variable", F.when(F.col("binary"), "binary").otherwise("numeric").alias("type"),
        F.round("m1", 4).alias("outlier_mean"), F.round("m0", 4).alias("full_mean"), F.round(F.col("m1") - F.col("m0"), 4).alias("difference"),
        F.when(F.col("binary"), "Fisher's Exact").otherwise("Welch's t-test").alias("test"), F.round(p, 4).alias("p_value"),
    )


def compare_sets(spectra: DataFrame, names: Sequence[str], keys: Sequence[str], replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """AUROC with interval and rank-sum p for every pair of sets and every frequency."""
    tagged = set_pairs(spectra, names)
    equal = equal_sized_sets(tagged, ["pair"], keys, seed)
    rows = tagged.join(equal, ["pair", "label", *keys], "left_semi")
    by = ["pair", "freq_hz"]
    return auroc_bootstrap(rows, by, "psd", replicates, seed).join(rank_sum(rows, by, "psd").select(*by, "p_value"), by)

