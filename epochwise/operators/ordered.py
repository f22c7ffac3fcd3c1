"""Ordered-series building blocks that never put a whole group into one task.

A plain ``Window.partitionBy(case)`` sends all rows of a case to one task, which fails when one
case holds a large share of the table. Here every series is cut into *chunks* (a time bucket, a
value range, a hash prefix). Row-level windows run per ``(group, chunk)``; one summary row per
chunk carries the state across chunk borders, and only those summary rows meet per group.

Cost: one exchange of the rows on ``(group, chunk)`` plus one tiny aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochwise.session import materialize

UP, UF = W.unboundedPreceding, W.unboundedFollowing
Exprs = dict[str, Column]


def scan(
    df: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str],
    *,
    sums: Exprs | None = None,
    lag: Exprs | None = None,
    lead: Exprs | None = None,
    ffill: Exprs | None = None,
    bfill: Exprs | None = None,
    totals: Exprs | None = None,
    firsts: Exprs | None = None,
    lasts: Exprs | None = None,
    attach: DataFrame | None = None,
) -> DataFrame:
    """Add order-dependent columns over each group, chunk by chunk.

    ``chunk`` must be monotone in ``order`` within a group, and ``order`` must be unique there.

    sums   running sum including the row          totals  sum over the whole group
    lag    value on the previous row              lead    value on the next row
    ffill  last non-null up to and with the row   bfill   next non-null from the row on
    firsts first non-null of the group            lasts   last non-null of the group
    attach one row per group whose columns are added to every row (joined to the small chunk
           summary, so that the rows themselves never meet on the group key)
    """
    sums, lag, lead = sums or {}, lag or {}, lead or {}
    ffill, bfill, totals = ffill or {}, bfill or {}, totals or {}
    firsts, lasts = firsts or {}, lasts or {}
    by = list(by)
    # Plain columns keep the chunk summary a hash aggregate; struct buffers would make it sort.
    key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])

    aggs = [F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()]
    aggs += [F.sum(e).alias(f"_tot_{n}") for n, e in totals.items()]
    aggs += [F.max_by(e, key).alias(f"_lag_{n}") for n, e in lag.items()]
    aggs += [F.min_by(e, key).alias(f"_lead_{n}") for n, e in lead.items()]
    for n, e in {**{f"_ff_{n}": e for n, e in ffill.items()}, **{f"_last_{n}": e for n, e in lasts.items()}}.items():
        aggs.append(F.max_by(e, F.when(e.isNotNull(), key)).alias(n))
    for n, e in {**{f"_bf_{n}": e for n, e in bfill.items()}, **{f"_first_{n}": e for n, e in firsts.items()}}.items():
        aggs.append(F.min_by(e, F.when(e.isNotNull(), key)).alias(n))

    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    up, down = group.orderBy(F.col(chunk)), group.orderBy(F.col(chunk).desc())
    before, after = up.rowsBetween(UP, -1), down.rowsBetween(UP, -1)
    carry = [F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}") for n in sums]
    carry += [F.sum(f"_tot_{n}").over(group).alias(f"_tot_{n}") for n in totals]
    carry += [F.lag(f"_lag_{n}").over(up).alias(f"_lag_{n}") for n in lag]
    carry += [F.lead(f"_lead_{n}").over(up).alias(f"_lead_{n}") for n in lead]
    carry += [F.last(f"_ff_{n}", ignorenulls=True).over(before).alias(f"_ff_{n}") for n in ffill]
    carry += [F.last(f"_bf_{n}", ignorenulls=True).over(after).alias(f"_bf_{n}") for n in bfill]
    whole = up.rowsBetween(UP, UF)
    carry += [F.first(f"_first_{n}", ignorenulls=True).over(whole).alias(f"_first_{n}") for n in firsts]
    carry += [F.last(f"_last_{n}", ignorenulls=True).over(whole).alias(f"_last_{n}") for n in lasts]
    context = df.groupBy(*by, chunk).agg(*aggs).select(*by, chunk, *carry)
    extra = []
    if attach is not None:
        context = context.join(attach, by, "left")
        extra = [c for c in attach.columns if c not in by]

    # Shuffled hash join: rows and summaries are exchanged on (group, chunk), which is also what the
    # row-level windows need, and only the one-row-per-chunk side is hashed.
    joined = df.join(context.hint("shuffle_hash"), [*by, chunk])
    local = W.partitionBy(*by, chunk).orderBy(*[F.col(c) for c in order])
    local_down = W.partitionBy(*by, chunk).orderBy(*[F.col(c).desc() for c in order])
    run, run_down = local.rowsBetween(UP, 0), local_down.rowsBetween(UP, 0)
    # A chunk border is recognised by the missing neighbour inside the chunk.
    first_row = F.lag(F.lit(True)).over(local).isNull() if lag else None
    last_row = F.lead(F.lit(True)).over(local).isNull() if lead else None
    out = [F.col(c) for c in [*df.columns, *extra]]
    out += [(F.col(f"_sum_{n}") + F.sum(e).over(run)).alias(n) for n, e in sums.items()]
    out += [F.col(f"_tot_{n}").alias(n) for n in totals]
    out += [F.when(first_row, F.col(f"_lag_{n}")).otherwise(F.lag(e).over(local)).alias(n) for n, e in lag.items()]
    out += [F.when(last_row, F.col(f"_lead_{n}")).otherwise(F.lead(e).over(local)).alias(n) for n, e in lead.items()]
    out += [F.coalesce(F.last(e, ignorenulls=True).over(run), F.col(f"_ff_{n}")).alias(n) for n, e in ffill.items()]
    out += [F.coalesce(F.last(e, ignorenulls=True).over(run_down), F.col(f"_bf_{n}")).alias(n) for n, e in bfill.items()]
    out += [F.col(f"_first_{n}").alias(n) for n in firsts]
    out += [F.col(f"_last_{n}").alias(n) for n in lasts]
    return joined.select(*out)


def join_small(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join on ``on``; with no keys ``right`` is a single row of totals and becomes a scalar subquery."""
    if on:
        return left.join(right, list(on))
    one = right.select(F.struct(*[F.col(c) for c in right.columns])).scalar()
    return left.withColumn("_one", one).select(*left.columns, *[F.col(f"_one.{c}").alias(c) for c in right.columns])


SENT_BYTES = 1 << 23  # limits of ranges that are broadcast


def value_chunks(df: DataFrame, by: Sequence[str], value: str, buckets: int, name: str = "_chunk", groups: int | None = None) -> DataFrame:
    """Order-preserving value range number per group, from mergeable quantile sketches.

    ``groups``: how many there are at most. The limits of few groups are broadcast, since an exchange by group would send all rows of a
    group to one task.
    """
    points = [i / buckets for i in range(1, buckets)]
    splits = df.groupBy(*by).agg(F.percentile_approx(value, points, 10 * buckets).alias("_splits"))
    if by and groups is not None and 8 * groups * buckets <= SENT_BYTES:
        splits = F.broadcast(splits)
    chunk = F.size(F.filter("_splits", lambda s: s < F.col(value)))
    return join_small(df, splits, by).withColumn(name, F.coalesce(chunk, F.lit(0))).drop("_splits")


def bounded_chunks(df: DataFrame, by: Sequence[str], value: str, rows_per_chunk: int, fan_out: int = 256) -> tuple[DataFrame, list[str]]:
    """Nested value ranges ``_c0, _c1, ...`` with about ``rows_per_chunk`` rows in the innermost one.

    The number of levels follows from the largest group, so no range grows with the data.
    """
    largest, groups = df.groupBy(*by).count().agg(F.max("count"), F.count(F.lit(1))).first()
    need, levels = -(-(largest or 0) // rows_per_chunk), []
    while True:
        parts = min(max(need, 1), fan_out)
        name = f"_c{len(levels)}"
        df = value_chunks(df, [*by, *levels], value, parts, name, groups) if parts > 1 else df.withColumn(name, F.lit(0))
        levels.append(name)
        groups *= parts
        need = -(-need // parts)
        if need <= 1:
            return df, levels


def cumulative(df: DataFrame, by: Sequence[str], value: str, measures: Exprs, rows_per_chunk: int = 100_000) -> DataFrame:
    """One row per distinct ``(by, value)``: each measure, what lies strictly below it, and its total.

    Equal values are counted together before the exchange, so a value that holds a third of all
    rows costs one row. Output columns per measure ``m``: ``m``, ``m_below``, ``m_total``.

    The counts are stored. Distinct values are cut into ranges of about ``rows_per_chunk`` rows by quantile sketches, however
    close to each other they lie; one count of the groups tells how many ranges there are.
    """
    by = list(by)
    # Read four times below: for the size of the groups, the sketches, the ranges' sums and the rows.
    grouped = materialize(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[e.alias(n) for n, e in measures.items()]), "counted")
    ranged, levels = bounded_chunks(grouped, by, value, rows_per_chunk)
    chunked = ranged.withColumn("_chunk", F.struct(*levels)).drop(*levels)
    out = scan(
        chunked, by, "_chunk", [value],
        sums={f"{n}_below": F.col(n) for n in measures},
        totals={f"{n}_total": F.col(n) for n in measures},
    )
    keep = [F.col(c) for c in (*by, value, *measures)]
    below = [(F.col(f"{n}_below") - F.col(n)).alias(f"{n}_below") for n in measures]
    return out.select(*keep, *below, *[F.col(f"{n}_total") for n in measures])


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group, without holding a group's values in one buffer."""
    by = list(by)
    c = cumulative(df, by, value, {"n": F.count(F.lit(1))})
    aggs = []
    for name, share in shares.items():
        pos = F.lit(float(share)) * (F.col("n_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(k: Column) -> Column:
            return F.max(F.when((F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n")), F.col(value)))

        frac = F.max(pos - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return c.groupBy(*by).agg(*aggs)


def stable_hash(seed: int | str, *keys: str) -> Column:
    """Order for seeded random choices; depends on key values only, never on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_order(
    df: DataFrame, by: Sequence[str], seed: int | str, keys: Sequence[str], name: str = "pick", digits: int = 3
) -> DataFrame:
    """1-based position of each row in the seeded random order of its group.

    A group is cut into ``16 ** digits`` chunks of equal expected size: 4,096 for few large groups
    (folds, roles, classes), fewer for many small ones.
    """
    h = df.withColumn("_h", stable_hash(seed, *keys)).withColumn("_hc", F.substring("_h", 1, digits))
    return scan(h, by, "_hc", ["_h", *keys], sums={name: F.lit(1)}).drop("_h", "_hc")


def take_random(df: DataFrame, by: Sequence[str], seed: int | str, keys: Sequence[str], n: Column) -> DataFrame:
    """The first ``n`` rows of each group in seeded random order (sampling without replacement).

    For few groups (folds, roles, classes): the counts per group and hash chunk, at most 4,096 rows per
    group, are broadcast. A chunk that lies wholly below ``n`` is taken and one wholly above it is left
    without moving its rows; only the one chunk per group that ``n`` cuts through is exchanged and
    ordered. With many groups filter :func:`hash_order` instead.
    """
    by = list(by)
    h = df.withColumn("_h", stable_hash(seed, *keys)).withColumn("_hc", F.substring("_h", 1, 3))
    before = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_hc").rowsBetween(UP, -1)
    counts = h.groupBy(*by, "_hc").agg(F.count(F.lit(1)).alias("_in"))
    counts = counts.withColumn("_below", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    placed = h.join(F.broadcast(counts), [*by, "_hc"])
    whole = placed.filter(F.col("_below") + F.col("_in") <= n)
    cut = placed.filter((F.col("_below") < n) & (F.col("_below") + F.col("_in") > n))
    order = W.partitionBy(*by, "_hc").orderBy("_h", *keys)
    part = cut.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n - F.col("_below")).drop("_rn")
    return whole.unionByName(part).select(*df.columns)
