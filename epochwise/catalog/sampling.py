"""Splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.catalog import inputs as I
from epochwise.operators import splits as S
from epochwise.operators.signal import zscore_columns

L = I.LABELLED
K = 'case_id, start, "end"'


def classes(s, d):
    f = I.labelled(s, d).select("case_id", "start", "end", "l_quantity", "l_extendedprice", "label")
    return f.filter("label = 1").drop("label"), f.filter("label = 0").drop("label")


def rows(s, d):
    return I.labelled(s, d).select("case_id", "start", "end", "label")


def roled(s, d):
    return rows(s, d).withColumn("role", F.when(F.col("case_id") % 6 == 0, "test").otherwise("train"))


ROLED = L + f", roled AS (SELECT {K}, label, CASE WHEN case_id % 6 = 0 THEN 'test' ELSE 'train' END AS role FROM labelled)"
_H = "md5('42:' || case_id || ':' || start || ':' || \"end\")"


def _balance(src: str, by: str, name: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""{name}0 AS (SELECT *, least(count(*) FILTER (label = 1) OVER ({part}), count(*) FILTER (label = 0) OVER ({part})) AS k,
  row_number() OVER (PARTITION BY {cols}label ORDER BY {_H}, {K}) AS rn FROM {src}), {name} AS (SELECT * EXCLUDE (k, rn) FROM {name}0 WHERE rn <= k)"""


def _adjust(src: str, by: str, ratio: float, name: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""{name}0 AS (SELECT *, count(*) FILTER (role = 'test') OVER ({part}) AS b, count(*) FILTER (role = 'train') OVER ({part}) AS a,
  row_number() OVER (PARTITION BY {cols}role ORDER BY {_H}, {K}) AS rn FROM {src}),
{name} AS (SELECT * EXCLUDE (a, b, rn) FROM {name}0 WHERE rn <= CASE WHEN role = 'test' THEN (CASE WHEN b / (a + b) > {ratio} THEN floor(a * {ratio}::DOUBLE / (1 - {ratio}::DOUBLE)) ELSE b END)
  ELSE (CASE WHEN b / (a + b) < {ratio} THEN floor(b * (1 - {ratio}::DOUBLE) / {ratio}::DOUBLE) ELSE a END) END)"""


def _greedy(prefix: str, source: str, excluded: str | None, test_size: float) -> str:
    """First trial of the case search as a recursion over the cases in hash order."""
    cond = f"WHERE case_id NOT IN (SELECT case_id FROM {excluded})" if excluded else ""
    return f"""{prefix}ord AS (SELECT case_id, count(*) AS n, row_number() OVER (ORDER BY md5('42:0:' || case_id), case_id) AS pos FROM {source} {cond} GROUP BY case_id),
{prefix}tgt AS (SELECT CAST(floor({test_size} * count(*)) AS BIGINT) AS t FROM {source}),
{prefix}walk AS (SELECT 0::BIGINT AS pos, 0::BIGINT AS s, NULL::BIGINT AS id, false AS took
  UNION ALL SELECT o.pos, CASE WHEN s + n <= t THEN s + n ELSE s END, case_id, s + n <= t FROM {prefix}walk w JOIN {prefix}ord o ON o.pos = w.pos + 1, {prefix}tgt
  WHERE abs(w.s - t) / t > 0.05),
{prefix}test AS (SELECT id AS case_id FROM {prefix}walk WHERE took)"""


SINGLE = L + ", " + _greedy("g", "labelled", None, 0.2) + f""", sp AS (SELECT {K}, label, CASE WHEN case_id IN (SELECT case_id FROM gtest) THEN 'test' ELSE 'train' END AS role FROM labelled),
""" + _balance("sp", "role", "bal") + ", " + _adjust("bal", "", 0.2, "adj")

FOLDSQL = L + """, ids AS (SELECT case_id, row_number() OVER (ORDER BY md5('42:' || case_id), case_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM labelled)),
own AS (SELECT case_id, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS own FROM ids)"""


def _disjoint(k: int, size: float) -> str:
    parts = []
    for i in range(k):
        used = None
        if i:
            parts.append(f"used{i} AS ({' UNION ALL '.join(f'SELECT case_id FROM f{j}test' for j in range(i))})")
            used = f"used{i}"
        parts.append(_greedy(f"f{i}", "labelled", used, size))
    return ", ".join(parts)


EXPERIMENT = L + f""", each0 AS (SELECT {K}, label, l_quantity, iteration, row_number() OVER (PARTITION BY iteration, label ORDER BY md5(iteration || ':' || case_id || ':' || start || ':' || "end"), {K}) AS rn
  FROM labelled, range(4) r(iteration)), sampled AS (SELECT {K}, label, l_quantity, CAST(iteration AS INT) AS iteration, size FROM each0, (VALUES (50), (200)) v(size) WHERE rn <= size // 2)"""


def sample_rows(s, d):
    return S.stratified_samples(I.labelled(s, d).select("case_id", "start", "end", "label", "l_quantity"), [50, 200], 4)


def normalised(s, d):
    base = I.labelled(s, d).select("case_id", "start", "end", "l_quantity")
    picked = sample_rows(s, d).filter("iteration = 1 and size = 200")
    return zscore_columns(base, ["l_quantity"], picked).withColumn("l_quantity", F.round("l_quantity", 6))


QUERIES = {
    "l1_case_split": (
        lambda s, d: S.find_case_split(S.case_counts(rows(s, d)), 0.15),
        f"WITH RECURSIVE {L}, {_greedy('g', 'labelled', None, 0.15)} SELECT DISTINCT case_id, CASE WHEN case_id IN (SELECT case_id FROM gtest) THEN 'test' ELSE 'train' END AS role FROM labelled"),
    "l2_class_balancing": (
        lambda s, d: S.balance_classes(rows(s, d)), f"WITH {L}, base AS (SELECT {K}, label FROM labelled), {_balance('base', '', 'bal')} SELECT * FROM bal"),
    "l3_ratio_adjustment": (
        lambda s, d: S.adjust_ratio(roled(s, d), 0.15), f"WITH {ROLED}, {_adjust('roled', '', 0.15, 'adj')} SELECT * FROM adj"),
    "l4_balanced_split": (
        lambda s, d: S.balanced_split(roled(s, d), 0.15), f"WITH {ROLED}, {_balance('roled', 'role', 'bal')}, {_adjust('bal', '', 0.15, 'adj')} SELECT * FROM adj"),
    "l5_single_split": (
        lambda s, d: S.single_split(*classes(s, d), 0.2).select("case_id", "start", "end", "label", "role"), f"WITH RECURSIVE {SINGLE} SELECT * FROM adj"),
    "l6_case_folds": (
        lambda s, d: S.case_folds(S.case_counts(rows(s, d)), 5), f"WITH {FOLDSQL} SELECT case_id, own AS fold FROM own"),
    "l6_cross_validation": (
        lambda s, d: S.cross_validation_splits(rows(s, d), 5, 0.2),
        f"""WITH {FOLDSQL}, ex AS (SELECT {K}, label, CAST(r.fold AS INT) AS fold, CASE WHEN r.fold = own THEN 'test' ELSE 'train' END AS role FROM labelled JOIN own USING (case_id), range(5) r(fold)),
        {_balance('ex', 'fold, role', 'bal')}, {_adjust('bal', 'fold', 0.2, 'adj')} SELECT * FROM adj"""),
    "l7_disjoint_folds": (
        lambda s, d: S.disjoint_folds(S.case_counts(rows(s, d)), 0.3).filter("role = 'test'").select("fold", "case_id"),
        f"WITH RECURSIVE {L}, {_disjoint(3, 0.3)} " + " UNION ALL ".join(f"SELECT {i} AS fold, case_id FROM f{i}test" for i in range(3))),
    "l7_custom_splits": (
        lambda s, d: S.custom_splits(*classes(s, d), 0.4).groupBy("fold", "role", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("start_sum")),
        f"""WITH RECURSIVE {L}, {_disjoint(2, 0.4)}, ex AS (SELECT {K}, label, v.fold, CASE WHEN (v.fold = 0 AND case_id IN (SELECT case_id FROM f0test)) OR (v.fold = 1 AND case_id IN (SELECT case_id FROM f1test))
          THEN 'test' ELSE 'train' END AS role FROM labelled, (VALUES (0), (1)) v(fold)), {_balance('ex', 'fold, role', 'bal')}, {_adjust('bal', 'fold', 0.4, 'adj')}
        SELECT fold, role, label, count(*) AS n, CAST(sum(start) AS BIGINT) AS start_sum FROM adj GROUP BY ALL"""),
    "l8_stratified_samples": (sample_rows, f"WITH {EXPERIMENT} SELECT * FROM sampled"),
    "l8_normalised_by_sample": (
        normalised, f"""WITH {EXPERIMENT}, st AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM sampled WHERE iteration = 1 AND size = 200)
        SELECT {K}, round((l_quantity - m) / sd, 6) AS l_quantity FROM labelled, st"""),
}
