"""Key filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.catalog import inputs as I
from epochwise.operators import keyed as K
from epochwise.session import load

L, FE = I.LABELLED, I.FEATURES
CASES = "(SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)"
KEYS_SQL = 'case_id, start, "end"'
ON = 'a.case_id = b.case_id AND a.start = b.start AND a."end" = b."end"'


def rich_suppliers(s, d):
    return load(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("case_id"))


def gappy(s, d):
    f = I.features(s, d)
    return f.withColumn("l_discount", F.when(F.col("start") % 9 != 0, F.col("l_discount"))).withColumn(
        "l_tax", F.when(F.col("start") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")))


GAPPY = FE + """, gappy AS (SELECT case_id, start, "end", l_quantity, l_extendedprice, l_returnflag, l_linestatus,
  CASE WHEN start % 9 <> 0 THEN l_discount END AS l_discount, CASE WHEN start % 5 = 0 THEN NULL ELSE l_tax END AS l_tax FROM feats)"""


def classes(s, d):
    f = I.features(s, d)
    cols = ["case_id", "start", "end", "l_quantity", "l_extendedprice"]
    return f.filter("l_returnflag = 'R'").select(*cols), f.filter("l_returnflag = 'A'").select(*cols)


def outliers(s, d):
    return K.misclassified(I.labelled(s, d), 1)


OUT = L + f", outl AS (SELECT DISTINCT {KEYS_SQL} FROM labelled WHERE label = 1 AND prediction <> label)"


def text_numbers(s, d):
    """Numbers as text, with blanks and words among them."""
    c = load(s, d, "customer")
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit("  ")).when(F.col("c_custkey") % 11 == 0, F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit(" ")))
    return c.select(F.col("c_custkey").alias("case_id"), text.alias("age"), "c_mktsegment")


def labelled_rows(s, d):
    a, b = classes(s, d)
    return K.labelled_union(a, b, rich_suppliers(s, d), outliers(s, d)).withColumn("l_quantity", F.round("l_quantity", 2))


def spectra_rows(s, d):
    """Frequency rows taken from the embeddings; every ninth frequency is degenerate in one set."""
    e = I.epoch_signals(s, d).select("case_id", "start", "end", "label", F.posexplode("eeg").alias("freq", "p"))
    flat = (F.col("freq") % 9 == 4) & (F.col("label") == 1)
    return e.select(
        "case_id", "start", "end", F.when(F.col("label") == 1, "awake").otherwise("faw").alias("set"),
        (F.col("freq") / 2).alias("freq_hz"), F.when(flat, F.lit(0.0)).otherwise(F.abs("p")).alias("psd"))


SPECTRA = I.SIGNALS + """, flatspec AS (SELECT case_id, start, "end", label, pos / 2 AS freq_hz, abs(eeg[pos + 1]) AS p, pos
  FROM (SELECT *, unnest(range(64)) AS pos FROM signals)),
spec AS (SELECT case_id, start, "end", CASE WHEN label = 1 THEN 'awake' ELSE 'faw' END AS set, freq_hz,
  CASE WHEN pos % 9 = 4 AND label = 1 THEN 0.0 ELSE p END AS psd FROM flatspec)"""


def key_sets(s, d):
    f = I.labelled(s, d)
    return K.outlier_sets(f.filter("label = 1"), f.filter("label = 0"), outliers(s, d))


SIDES = FE + f""", a AS (SELECT {KEYS_SQL} FROM feats WHERE start % 5 <> 1), b AS (SELECT {KEYS_SQL} FROM feats WHERE l_quantity > 3),
  not_b AS (FROM a EXCEPT FROM b), not_a AS (FROM b EXCEPT FROM a)"""


def incremental(s, d):
    f = I.features(s, d)
    return K.still_to_do(f.select("case_id", "start", "end"), f.filter("l_linestatus = 'F'"))


def folds(s, d):
    """A split table in which rows sit in several folds."""
    f = I.labelled(s, d)
    return f.withColumn("fold", F.explode(F.sequence(F.lit(0), F.pmod("start", F.lit(3)).cast("int"))))


FOLDS = L + ", folds AS (SELECT * EXCLUDE (fold), unnest(range(CAST(start % 3 AS INT) + 1)) AS fold FROM labelled)"


def spectra_query(s, d):
    sp = spectra_rows(s, d)
    listed = I.epoch_signals(s, d).filter("label = 1").select("case_id", "start", "end")
    return K.spectra_of(listed, sp.drop("set")).withColumn("psd", F.round("psd", 6))


QUERIES = {
    "c5_complete_rows": (
        lambda s, d: K.complete_rows(gappy(s, d)).select("case_id", "start", "end", "l_discount", "l_tax"),
        f"WITH {GAPPY} SELECT {KEYS_SQL}, l_discount, l_tax FROM gappy WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL"),
    "c6_exclude_cases": (
        lambda s, d: K.exclude_cases(I.features(s, d), rich_suppliers(s, d)).select("case_id", "start", "end", "l_quantity"),
        f"WITH {FE} SELECT {KEYS_SQL}, l_quantity FROM feats WHERE case_id NOT IN {CASES}"),
    "c9_misclassified_epochs": (
        lambda s, d: outliers(s, d), f"WITH {L} SELECT {KEYS_SQL} FROM labelled WHERE label = 1 AND prediction <> label"),
    "c10_drop_bands": (
        lambda s, d: K.drop_bands(I.features(s, d).select("case_id", "start", "end", F.col("l_quantity").alias("Delta"), F.col("l_tax").alias("Theta"),
                                                           F.col("l_discount").alias("Alpha"), F.col("l_extendedprice").alias("Beta")), ["Alpha", "Beta"]),
        f'WITH {FE} SELECT {KEYS_SQL}, l_discount AS "Alpha", l_extendedprice AS "Beta" FROM feats'),
    "c11_numeric_coercion": (
        lambda s, d: K.coerce_numeric(text_numbers(s, d), ["age"]).select("case_id", "age"),
        "SELECT c_custkey AS case_id, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS age FROM customer"),
    "c12_category_to_number": (
        lambda s, d: K.map_categories(load(s, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("seg")),
                                      {"seg": {"BUILDING": 0, "MACHINERY": 1}}),
        "SELECT c_custkey AS case_id, CASE c_mktsegment WHEN 'BUILDING' THEN 0.0::DOUBLE WHEN 'MACHINERY' THEN 1.0::DOUBLE END AS seg FROM customer"),
    "c13_degenerate_frequencies": (
        lambda s, d: K.drop_degenerate_frequencies(spectra_rows(s, d))[0].withColumn("psd", F.round("psd", 6)),
        f"""WITH {SPECTRA}, bad AS (SELECT freq_hz FROM spec GROUP BY set, freq_hz HAVING min(psd) = max(psd))
        SELECT case_id, start, "end", set, freq_hz, round(psd, 6) AS psd FROM spec WHERE freq_hz NOT IN (FROM bad)"""),
    "c13_skipped_frequencies": (
        lambda s, d: K.drop_degenerate_frequencies(spectra_rows(s, d))[1],
        f"WITH {SPECTRA} SELECT set, freq_hz FROM spec GROUP BY set, freq_hz HAVING min(psd) = max(psd)"),
    "c14_tag_and_round": (
        lambda s, d: K.tag_and_round(*classes(s, d), ("AW", "FAW"), ["l_quantity", "l_extendedprice"], 1),
        f"""WITH {FE} SELECT {KEYS_SQL}, round(l_quantity, 1) AS l_quantity, round(l_extendedprice, 1) AS l_extendedprice,
        CASE l_returnflag WHEN 'R' THEN 'AW' ELSE 'FAW' END AS class FROM feats WHERE l_returnflag IN ('R', 'A')"""),
    "d2_combined_features": (
        lambda s, d: K.combine_features({
            "a": gappy(s, d).select(*K.KEYS, "l_quantity"), "missing": None,
            "b": gappy(s, d).filter("l_linestatus = 'F'").select(*K.KEYS, "l_discount"), "c": gappy(s, d).select(*K.KEYS, "l_tax")}),
        f"WITH {GAPPY} SELECT {KEYS_SQL}, l_quantity, l_discount, l_tax FROM gappy WHERE l_linestatus = 'F' AND l_discount IS NOT NULL AND l_tax IS NOT NULL"),
    "d5_remove_epochs": (
        lambda s, d: K.remove_epochs(I.labelled(s, d), outliers(s, d)).select(*K.KEYS, "label"),
        f"WITH {L} SELECT {KEYS_SQL}, label FROM labelled WHERE NOT (label = 1 AND prediction <> label)"),
    "d6_outlier_rows": (
        lambda s, d: K.split_by_outliers(I.labelled(s, d), outliers(s, d))[0].select(*K.KEYS, "l_quantity"),
        f"WITH {OUT} SELECT a.case_id, a.start, a.\"end\", a.l_quantity FROM labelled a JOIN outl b ON {ON}"),
    "d6_outlier_label": (
        lambda s, d: K.label_outliers(I.labelled(s, d), outliers(s, d)).select(*K.KEYS, "label"),
        f"WITH {L} SELECT {KEYS_SQL}, CAST(CASE WHEN label = 1 AND prediction <> label THEN 2 ELSE label END AS INT) AS label FROM labelled"),
    "d7_key_sets": (
        key_sets,
        f"""WITH {L} SELECT {KEYS_SQL}, CASE WHEN label = 0 THEN 'faw' WHEN prediction <> label THEN 'wrong_awake' ELSE 'correct_awake' END AS set FROM labelled"""),
    "d8_spectra_of_epochs": (
        spectra_query, f"""WITH {SPECTRA} SELECT case_id, start, "end", freq_hz, round(psd, 6) AS psd FROM spec WHERE set = 'awake'"""),
    "d12_cohort_slice": (
        lambda s, d: K.cohort_slice(I.cohort(s, d), rich_suppliers(s, d), ["anestart", "c_mktsegment"]),
        f"WITH {I.COHORT} SELECT CAST(case_id AS VARCHAR) AS case_id, anestart, c_mktsegment FROM cohort WHERE case_id IN {CASES}"),
    "d13_lookup_with_default": (
        lambda s, d: K.lookup_with_default(load(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id")),
                                           I.cohort(s, d).filter("anestart > 0"), "anestart", 600.0),
        f"WITH {I.COHORT} SELECT o_orderkey, o_custkey AS case_id, coalesce(anestart, 600.0) AS anestart FROM orders LEFT JOIN (SELECT * FROM cohort WHERE anestart > 0) c ON o_custkey = case_id"),
    "d14_missing_counterparts": (
        lambda s, d: K.missing_counterparts(I.cohort(s, d), load(s, d, "events").select(F.col("user_id").alias("case_id"))),
        f"WITH {I.COHORT} SELECT DISTINCT case_id FROM cohort WHERE case_id NOT IN (SELECT user_id FROM events)"),
    "g1_key_order": (
        lambda s, d: K.ordered_output(I.labelled(s, d).select("label", *K.KEYS), ["label", "case_id", "start"]),
        f"WITH {L} SELECT label, {KEYS_SQL} FROM labelled ORDER BY label, case_id, start"),
    "h1_labelled_union": (
        labelled_rows,
        f"""WITH {OUT} SELECT a.case_id, a.start, a."end", round(l_quantity, 2) AS l_quantity, l_extendedprice, label,
        md5(label || ':' || a.case_id || ':' || a.start || ':' || a."end") AS orig_index FROM labelled a ANTI JOIN outl b ON {ON} WHERE a.case_id NOT IN {CASES}"""),
    "h2_key_comparison": (
        lambda s, d: K.compare_keys(I.features(s, d).filter("start % 5 <> 1"), I.features(s, d).filter("l_quantity > 3")),
        f"""WITH {SIDES} SELECT (SELECT count(*) FROM not_b) = 0 AS a_in_b, (SELECT count(*) FROM not_a) = 0 AS b_in_a,
        (SELECT count(*) FROM not_a) AS missing_from_a, (SELECT count(*) FROM not_b) AS missing_from_b"""),
    "h2_missing_keys": (
        lambda s, d: K.missing_keys(I.features(s, d).filter("start % 5 <> 1"), I.features(s, d).filter("l_quantity > 3")),
        f"WITH {SIDES} SELECT *, 'a' AS missing_from FROM not_a UNION ALL SELECT *, 'b' FROM not_b"),
    "h3_incremental_epochs": (incremental, f"WITH {FE} SELECT {KEYS_SQL} FROM feats WHERE l_linestatus <> 'F'"),
    "h4_distinct_epochs": (
        lambda s, d: K.distinct_epochs(folds(s, d)).select(*K.KEYS, "label"), f"WITH {FOLDS} SELECT DISTINCT {KEYS_SQL}, label FROM folds"),
}
