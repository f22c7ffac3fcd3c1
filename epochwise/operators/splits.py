"""Case-disjoint, class-balanced train and test sets.

Random choices follow the md5 order of seed and key (see ``ordered.stable_hash``): the same rows are
drawn whatever the partitioning, and a retried task draws them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochwise.operators.keyed import exclude_cases, labelled_union
from epochwise.operators.ordered import hash_order, join_small, scan, stable_hash, take_random
from epochwise.session import materialize

KEYS = ["case_id", "start", "end"]


def case_counts(df: DataFrame) -> DataFrame:
    """Rows per case, stored: the searches below read this small table many times."""
    return materialize(_case_counts(df), "case_counts")


def _case_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def _search(counts: DataFrame, trials: range, target: int, tolerance: float, seed: int) -> DataFrame:
    """Cases chosen by each trial: ``trial, case_id, n``.

    A trial walks the cases in its random order, takes a case when it still fits into ``target`` and
    stops once the sum is within the tolerance. Before the stop the sum is below
    ``(1 - tolerance) * target``, so a case of at most ``tolerance * target`` rows always fits: only
    *large* cases can be passed over, and there are at most ``total / (tolerance * target)`` of
    them. The small ones therefore come from running sums, and only the few large ones are walked
    one by one in an array.
    """
    def reached(total: Column) -> Column:
        # Not below the target by more than the tolerance; sums past the stop count as reached too.
        return (F.lit(target) - total) / F.lit(float(target)) <= tolerance

    ids = counts.withColumn("trial", F.explode(F.sequence(F.lit(trials.start), F.lit(trials.stop - 1))))
    ids = ids.withColumn("_h", stable_hash(seed, "trial", "case_id")).withColumn("_hc", F.substring("_h", 1, 3))
    ids = ids.withColumn("_large", F.col("n") > tolerance * target)
    ids = scan(ids, ["trial"], "_hc", ["_h", "case_id"], sums={"_small": F.when(F.col("_large"), 0).otherwise(F.col("n"))})
    event = "struct<h:string,id:bigint,n:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(False).alias("done"), F.array().cast(f"array<{event}>").alias("picked"))

    def step(acc: Column, x: Column) -> Column:
        before = x.small + acc.taken
        done = acc.done | reached(before)
        take = ~done & (before + x.n <= target)
        mine = F.array(F.struct(x.h.alias("h"), x.id.cast("long").alias("id"), x.n.alias("n")))
        return F.struct(
            F.when(take, acc.taken + x.n).otherwise(acc.taken).alias("taken"),
            (done | (take & reached(before + x.n))).alias("done"),
            F.when(take, F.concat(acc.picked, mine)).otherwise(acc.picked).alias("picked"),
        )

    large = F.array_sort(F.collect_list(F.struct(
        F.col("_h").alias("h"), F.col("case_id").cast("long").alias("id"), F.col("_small").cast("long").alias("small"), F.col("n").cast("long").alias("n"))))
    walked = ids.filter("_large").groupBy("trial").agg(F.aggregate(large, start, step).picked.alias("_picked"))
    # At most max_iter rows with a bounded array each: safe to broadcast, and the join key has few values.
    ids = ids.join(F.broadcast(walked), "trial", "left")
    earlier = F.filter("_picked", lambda e: (e.h < F.col("_h")) | ((e.h == F.col("_h")) & (e.id < F.col("case_id"))))
    taken = F.coalesce(F.aggregate(earlier, F.lit(0).cast("long"), lambda a, e: a + e.n), F.lit(0).cast("long"))
    small_ok = ~reached(F.col("_small") - F.col("n") + taken)
    large_ok = F.coalesce(F.exists("_picked", lambda e: e.id == F.col("case_id")), F.lit(False))
    return ids.filter(F.when(F.col("_large"), large_ok).otherwise(small_ok)).select("trial", "case_id", "n")


def find_case_split(
    counts: DataFrame, test_size: float, tolerance: float = 0.05, max_iter: int = 500, seed: int = 42, used: DataFrame | None = None
) -> DataFrame:
    """L1: ``case_id, role`` with the test rows close to ``test_size`` of all rows.

    The first trial within the tolerance wins, else the one with the smallest difference. Trials run
    in growing batches, since nearly always the first one succeeds. ``used`` cases stay out of the
    test set; too few remaining rows are an error.
    """
    free = counts if used is None else exclude_cases(counts, used)
    total = counts.agg(F.sum("n")).first()[0] or 0
    available = total if used is None else free.agg(F.sum("n")).first()[0] or 0
    target = int(test_size * total)
    if target < 1 or available < target:
        raise ValueError(f"the cases left hold {available} rows, a test set takes {target}")
    best = None
    at, width = 0, 1
    while at < max_iter:
        trials = range(at, min(at + width, max_iter))
        chosen = _search(free, trials, target, tolerance, seed)
        sums = chosen.groupBy("trial").agg(F.sum("n").alias("s")).withColumn("_diff", F.lit(target) - F.col("s"))
        inside = F.col("_diff") / F.lit(float(target)) <= tolerance
        first = sums.orderBy(F.when(inside, 0).otherwise(1), F.when(inside, F.col("trial")).otherwise(F.col("_diff")), "trial").first()
        if first is not None and (best is None or first["_diff"] < best[0]):
            best = (first["_diff"], first["trial"], chosen)
        if best is not None and best[0] / target <= tolerance:
            break
        at, width = trials.stop, width * 16
    if best is None:
        raise ValueError("no case fits into the test set")
    test = best[2].filter(F.col("trial") == best[1]).select("case_id", F.lit("test").alias("role"))
    # Later steps read the choice several times; the table has one row per case.
    return materialize(
        counts.select("case_id").join(test, "case_id", "left").withColumn("role", F.coalesce("role", F.lit("train"))), "case_split"
    )


def _attach_few(df: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a table of one row per fold or role: its size is bounded by their number, so it is broadcast."""
    return df.join(F.broadcast(table), list(by)) if by else join_small(df, table, [])


def balance_classes(df: DataFrame, seed: int = 42, by: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """L2: the larger class reduced at random to the size of the smaller one."""
    sizes = df.groupBy(*by).agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("_k"))
    return take_random(_attach_few(df, sizes, by), [*by, "label"], seed, list(keys), F.col("_k")).drop("_k")


def adjust_ratio(df: DataFrame, ratio: float, seed: int = 42, by: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """L3: reduce the role that is too large, so that the test share becomes ``ratio``."""
    a, b = F.count_if(F.col("role") == "train"), F.count_if(F.col("role") == "test")
    n = df.groupBy(*by).agg(a.alias("_a"), b.alias("_b"))
    share = F.try_divide(F.col("_b").cast("double"), (F.col("_a") + F.col("_b")).cast("double"))
    keep_test = F.when(share > ratio, F.floor(F.col("_a") * ratio / (1 - ratio))).otherwise(F.col("_b"))
    keep_train = F.when(share < ratio, F.floor(F.col("_b") * (1 - ratio) / ratio)).otherwise(F.col("_a"))
    n = n.select(*by, keep_test.alias("_kt"), keep_train.alias("_kr"))
    bound = F.when(F.col("role") == "test", F.col("_kt")).otherwise(F.col("_kr"))
    return take_random(_attach_few(df, n, by), [*by, "role"], seed, list(keys), bound).drop("_kt", "_kr")


def balanced_split(rows: DataFrame, ratio: float | None, seed: int = 42, by: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """L4: rows with a ``role`` balanced per role and, if a ratio is given, adjusted to it."""
    out = balance_classes(rows, seed, [*by, "role"], keys)
    return out if ratio is None else adjust_ratio(materialize(out, "balanced"), ratio, seed, by, keys)


def single_split(
    class_1: DataFrame, class_0: DataFrame, test_size: float = 0.2, seed: int = 42, ignore_cases: DataFrame | None = None
) -> DataFrame:
    """Labelled rows with role, case-disjoint, balanced, adjusted to the ratio."""
    rows = labelled_union(class_1, class_0, ignore_cases)
    roles = find_case_split(case_counts(rows), test_size, seed=seed)
    return balanced_split(rows.join(roles, "case_id"), test_size, seed)


def case_folds(counts: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Shuffled cases cut into ``k`` folds whose sizes differ by at most one case."""
    ranked = hash_order(counts.select("case_id"), [], seed, ["case_id"], "_r")
    n = counts.agg(F.count(F.lit(1)).alias("_n"))
    r, base, extra = F.col("_r") - 1, F.floor(F.col("_n") / k), F.col("_n") % k
    cut = extra * (base + 1)
    fold = F.when(r < cut, F.floor(r / (base + 1))).otherwise(extra + F.floor(F.try_divide(r - cut, base)))
    return join_small(ranked, n, []).select("case_id", fold.cast("int").alias("fold"))


def cross_validation_splits(rows: DataFrame, k: int = 5, test_size: float | None = 0.2, seed: int = 42) -> DataFrame:
    """Each row once per fold, test in its own fold and train in the others, every fold balanced.

    Same rows as :func:`balanced_split` takes fold by fold. Rows are stored once, not once a fold: counts by own fold, class
    and hash chunk, at most ``k * 2 * 4096``, tell for every fold, role and class the one chunk that its number of rows cuts through,
    and likewise for the ratio. Only rows of those chunks are exchanged and ranked; all others are repeated or dropped as they are read.
    """
    folds = case_folds(case_counts(rows), k, seed).withColumnRenamed("fold", "_own")
    marked = rows.join(folds, "case_id").withColumn("_h", stable_hash(seed, *KEYS)).withColumn("_hc", F.substring("_h", 1, 3))
    return _balanced_folds(materialize(marked, "own-folds"), k, test_size).select(*rows.columns, "fold", "role")


def _balanced_folds(marked: DataFrame, k: int, test_size: float | None) -> DataFrame:
    """Rows with ``_own`` (the fold that tests them, null if none does), ``_h`` and ``_hc``, once for each of ``k`` folds, balanced and adjusted."""
    def each(df: DataFrame) -> DataFrame:
        out = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        return out.withColumn("role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train"))

    def cut(counts: DataFrame, by: list[str], wanted: Column) -> DataFrame:
        """The chunk in which a group's first ``wanted`` rows end (one past all if it has no more), and how many are in it."""
        below = W.partitionBy(*by).orderBy("_hc").rowsBetween(W.unboundedPreceding, -1)
        placed = counts.withColumn("_below", F.coalesce(F.sum("_in").over(below), F.lit(0))).withColumn("_want", wanted)
        over = placed.filter(F.col("_below") + F.col("_in") > F.col("_want")).groupBy(*by).agg(F.min_by(F.struct("_hc", (F.col("_want") - F.col("_below")).alias("need")), "_hc").alias("_c"))
        every = placed.select(*by).distinct()
        return every.join(over, by, "left").select(*by, F.coalesce("_c._hc", F.lit("zzz")).alias("_cut"), F.coalesce("_c.need", F.lit(0)).alias("_need"))

    counts = each(marked.groupBy("_own", "label", "_hc").agg(F.count(F.lit(1)).alias("_n"))).groupBy("fold", "role", "label", "_hc").agg(F.sum("_n").alias("_in"))
    counts = materialize(counts, "chunk-counts")
    sizes = counts.groupBy("fold", "role").agg(F.least(*[F.coalesce(F.sum(F.when(F.col("label") == c, F.col("_in"))), F.lit(0)) for c in (0, 1)]).alias("_k"))
    one = materialize(cut(counts.join(F.broadcast(sizes), ["fold", "role"]), ["fold", "role", "label"], F.col("_k")), "class-cuts")
    table = one.withColumnsRenamed({"_cut": "_cut1", "_need": "_need1"})
    if test_size is None:
        table = table.withColumns({"_cut2": F.lit("zzz"), "_need2": F.lit(0)})
    else:
        left = F.when(F.col("_hc") < F.col("_cut"), F.col("_in")).when(F.col("_hc") == F.col("_cut"), F.col("_need")).otherwise(0)
        kept = counts.join(F.broadcast(one), ["fold", "role", "label"]).groupBy("fold", "role", "_hc").agg(F.sum(left).alias("_in"))
        kept = materialize(kept, "balanced-counts")
        a, b = (F.coalesce(F.sum(F.when(F.col("role") == r, F.col("_in"))), F.lit(0)) for r in ("train", "test"))
        n = kept.groupBy("fold").agg(a.alias("_a"), b.alias("_b"))
        share = F.try_divide(F.col("_b").cast("double"), (F.col("_a") + F.col("_b")).cast("double"))
        keep_test = F.when(share > test_size, F.floor(F.col("_a") * test_size / (1 - test_size))).otherwise(F.col("_b"))
        keep_train = F.when(share < test_size, F.floor(F.col("_b") * (1 - test_size) / test_size)).otherwise(F.col("_a"))
        n = n.select("fold", F.explode(F.array(F.struct(F.lit("test").alias("role"), keep_test.alias("n")), F.struct(F.lit("train").alias("role"), keep_train.alias("n")))).alias("_r"))
        n = n.select("fold", "_r.role", F.col("_r.n").alias("_keep"))
        two = cut(kept.join(F.broadcast(n), ["fold", "role"]), ["fold", "role"], F.col("_keep"))
        table = table.join(two.withColumnsRenamed({"_cut": "_cut2", "_need": "_need2"}), ["fold", "role"])
    # One row for each fold, role and class.
    placed = each(marked).join(F.broadcast(materialize(table, "cuts")), ["fold", "role", "label"]).filter((F.col("_hc") <= F.col("_cut1")) & (F.col("_hc") <= F.col("_cut2")))
    at_edge = (F.col("_hc") == F.col("_cut1")) | (F.col("_hc") == F.col("_cut2"))
    order = ["_h", *KEYS]
    edge = placed.filter(at_edge).withColumn("_r1", F.row_number().over(W.partitionBy("fold", "role", "label", "_hc").orderBy(*order)))
    edge = edge.filter((F.col("_hc") < F.col("_cut1")) | (F.col("_r1") <= F.col("_need1")))
    edge = edge.withColumn("_r2", F.row_number().over(W.partitionBy("fold", "role", "_hc").orderBy(*order)))
    edge = edge.filter((F.col("_hc") < F.col("_cut2")) | (F.col("_r2") <= F.col("_need2")))
    columns = [*marked.columns, "fold", "role"]
    return placed.filter(~at_edge).select(*columns).unionByName(edge.select(*columns))


def training_statistics(rows: DataFrame, folds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """J4 fitted on training rows: ``fold, m_<column>, s_<column>``, mean and population spread over the fold's training cases.

    ``folds``: ``fold, case_id, role``. One pass over ``rows``, however many folds there are: rows are summed by the set of folds whose
    test cases they belong to, and a fold's training rows are the union of all such sums that do not name it. Count, mean
    and spread of sums are merged, never subtracted, so nothing cancels.
    """
    tests = folds.filter("role = 'test'").groupBy("case_id").agg(F.array_sort(F.collect_set("fold")).alias("_tests"))
    none = F.array().cast(tests.schema["_tests"].dataType)
    known = folds.select("case_id").distinct().join(tests, "case_id", "left").select("case_id", F.coalesce("_tests", none).alias("_tests"))
    x = {c: F.col(c).cast("double") for c in columns}
    sums = rows.join(known, "case_id").groupBy("_tests").agg(*[f(x[c]).alias(f"{name}_{c}") for c in columns for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()
    names = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    out = []
    for fold in names:
        row = [fold]
        for c in columns:
            n = m = q = 0.0
            for r in sums:
                if fold not in r["_tests"] and r[f"n_{c}"]:
                    k, off = r[f"n_{c}"], r[f"m_{c}"] - m
                    q += r[f"v_{c}"] * k + off * off * n * k / (n + k)
                    m += off * k / (n + k)
                    n += k
            row += [m if n else None, (q / n) ** 0.5 if n else None]
        out.append(tuple(row))
    schema = f"fold {folds.schema['fold'].dataType.simpleString()}, " + ", ".join(f"`m_{c}` double, `s_{c}` double" for c in columns)
    return rows.sparkSession.createDataFrame(out, schema)


def scale_by_training(splits: DataFrame, statistics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of each fold, training and test, as z-scores by :func:`training_statistics`; a column without spread is null."""
    # One row a fold.
    joined = splits.join(F.broadcast(statistics), "fold")
    return joined.select(*[F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias(c) if c in columns else F.col(c) for c in splits.columns])


def disjoint_folds(counts: DataFrame, test_size: float, min_iterations: int | None = None, seed: int = 42) -> DataFrame:
    """``fold, case_id, role``; test cases are never used twice, folds end when too few rows remain."""
    limit = max(min_iterations or 0, int(1 // test_size))
    out = used = None
    for fold in range(limit):
        try:
            roles = find_case_split(counts, test_size, seed=seed, used=used)
        except ValueError:
            if out is None:
                raise
            break
        part = roles.withColumn("fold", F.lit(fold))
        test = roles.filter("role = 'test'").select("case_id")
        out = part if out is None else out.unionByName(part)
        used = test if used is None else used.unionByName(test)
    return out


def custom_splits(
    class_1: DataFrame, class_0: DataFrame, test_size: float, min_iterations: int | None = None, seed: int = 42,
    ignore_cases: DataFrame | None = None, ignore_epochs: DataFrame | None = None,
) -> DataFrame:
    """Balanced rows of all non-overlapping folds.

    Same rows as :func:`balanced_split` takes fold by fold. As a case is tested in one fold at most, counts by that fold, class and hash
    chunk tell which rows stay, as in :func:`cross_validation_splits`; rows are not repeated per fold before that, and are not stored.
    """
    rows = labelled_union(class_1, class_0, ignore_cases, ignore_epochs)
    folds = disjoint_folds(case_counts(rows), test_size, min_iterations, seed)
    k = folds.agg(F.max("fold")).first()[0] + 1
    own = folds.filter("role = 'test'").select("case_id", F.col("fold").alias("_own"))
    marked = rows.filter("case_id IS NOT NULL").join(own, "case_id", "left").withColumn("_h", stable_hash(seed, *KEYS)).withColumn("_hc", F.substring("_h", 1, 3))
    return _balanced_folds(marked, k, test_size).select(*marked.drop("_own", "_h", "_hc").columns, "role", "fold")


def stratified_samples(rows: DataFrame, sizes: Sequence[int], iterations: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each size and iteration half of the size from each class, without replacement.

    An iteration has one random order per class and a size takes its beginning, so rows are repeated
    per iteration only. A row can be among the wanted first ones only if its hash lies below their share of the
    class; ten standard deviations are added to that share, so what is exchanged and ordered is about ``max(sizes) / 2``
    rows per iteration and class, however many rows there are. Rows with equal keys have one hash; where a class comes out
    short because of them, the share is widened until every class and iteration has its rows.
    """
    bound = max(sizes) // 2
    counts = rows.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.max("_n"), F.sum(F.least("_n", F.lit(bound)))).first()
    most, wanted = total[0] or 0, (total[1] or 0) * iterations
    # One row a class: a join that exchanges rows would send each class to one task.
    each = rows.join(F.broadcast(counts), "label").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    each = each.withColumn("_h", F.md5(F.concat_ws(":", "iteration", *[F.col(k).cast("string") for k in keys])))
    order = W.partitionBy("iteration", "label").orderBy("_h", *keys)
    near = float(bound + 10 * bound**0.5 + 50)
    while True:
        low = each.filter(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2.0**32 <= F.lit(near) / F.col("_n")).drop("_n")
        first = materialize(low.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= bound), "first")
        if near >= most or first.count() == wanted:
            break
        near *= 4
    sized = first.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    picked = sized.filter(F.col("_rn") <= F.floor(F.col("size") / 2))
    return picked.select(*rows.columns, "iteration", "size")
