"""Waveforms, spectra and epoch features."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochwise.catalog import inputs as I
from epochwise.catalog.inputs import BLOCK, FS
from epochwise.functions import features as X
from epochwise.operators import epochs as P
from epochwise.operators import signal as G
from epochwise.operators.ordered import take_random
from epochwise.session import load, materialize

KEYS = G.KEYS
SEG = 0.5  # seconds per Welch segment: 16 samples


def _r(df, *cols, n=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def blocks(s, d):
    return materialize(G.to_blocks(I.samples(s, d), FS, BLOCK), "blocks")


def _flat(df):
    return _r(G.to_samples(df, BLOCK), "ch1", "ch2")


def spectra(s, d):
    return G.epoch_spectra(I.epoch_signals(s, d), FS, SEG)


def features(s, d, names, overrides=None):
    return G.extract_features(spectra(s, d), names, overrides=overrides)


FLAT = I.SIGNALS + """, flat AS (SELECT case_id, start, "end", pos, eeg[pos + 1] AS x, label FROM (SELECT *, unnest(range(64)) AS pos FROM signals))"""
WELCH = FLAT + """, segs AS (SELECT case_id, start, "end", g, pos - g * 8 AS i, x FROM flat, range(7) r(g) WHERE pos >= g * 8 AND pos < g * 8 + 16),
cent AS (SELECT *, (x - avg(x) OVER (PARTITION BY case_id, start, "end", g)) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS y FROM segs),
dft AS (SELECT case_id, start, "end", g, k, sum(y * cos(2 * pi() * k * i / 16)) AS re, sum(y * sin(2 * pi() * k * i / 16)) AS im FROM cent, range(9) r(k) GROUP BY ALL),
wsum AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 16), 2)) AS w2 FROM range(16) r(i)),
welch AS (SELECT case_id, start, "end", k * 2.0 AS f, avg((re * re + im * im) / (32 * w2) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) AS p FROM dft, wsum GROUP BY ALL)"""
MOMENT = WELCH + """, tot AS (SELECT *, sum(p) OVER (PARTITION BY case_id, start, "end") AS t FROM welch), q0 AS (SELECT *, p / t AS q FROM tot),
mu AS (SELECT *, sum(q * f) OVER (PARTITION BY case_id, start, "end") AS m FROM q0)"""


BANDPOWER = WELCH + """, tz AS (SELECT case_id, start, "end", band, sum(a) AS a FROM (
    SELECT case_id, start, "end", band, (p + lead(p) OVER w) / 2 * (lead(f) OVER w - f) AS a FROM welch JOIN bands ON f >= lo AND f < hi
    WINDOW w AS (PARTITION BY case_id, start, "end", band ORDER BY f)) GROUP BY ALL),
bp AS (SELECT case_id, start, "end", coalesce(max(a) FILTER (band = 'all'), 0) AS w, coalesce(max(a) FILTER (band = 'Delta'), 0) AS d,
    coalesce(max(a) FILTER (band = 'Theta'), 0) AS t, coalesce(max(a) FILTER (band = 'Alpha'), 0) AS a, coalesce(max(a) FILTER (band = 'Beta'), 0) AS b FROM tz GROUP BY ALL)
SELECT case_id, start, "end", round(CASE WHEN w > 0 THEN d / w ELSE 0 END, 6) AS "Delta", round(CASE WHEN w > 0 THEN t / w ELSE 0 END, 6) AS "Theta",
  round(CASE WHEN w > 0 THEN a / w ELSE 0 END, 6) AS "Alpha", round(CASE WHEN w > 0 THEN b / w ELSE 0 END, 6) AS "Beta" FROM bp"""


def _bands(whole: str) -> str:
    return f"bands(band, lo, hi) AS (VALUES ('all', {whole}), ('Delta', 0.5, 4), ('Theta', 4, 8), ('Alpha', 8, 13), ('Beta', 13, 30)), "


PAIRS = FLAT + """, sd AS (SELECT case_id, start, "end", 0.2 * stddev_pop(x) AS r FROM flat GROUP BY ALL),
tm AS (SELECT case_id, start, "end", pos, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM flat WINDOW w AS (PARTITION BY case_id, start, "end" ORDER BY pos)),
t3 AS (SELECT * FROM tm WHERE pos < 62)"""


def epoch_table(s, d):
    """Epochs of 2.25 s every 1.7 s on the strung-together waveform, some reaching past its end."""
    e = load(s, d, "embeddings").select(
        (F.col("vec_id") % 40).alias("case_id"), (F.floor(F.col("vec_id") / 40) * 2.1).alias("start"))
    return e.withColumn("end", F.col("start") + 2.25)


EPOCHS = I.SAMPLES + """, ep AS (SELECT vec_id % 40 AS case_id, (vec_id // 40) * 2.1::DOUBLE AS start, (vec_id // 40) * 2.1::DOUBLE + 2.25 AS "end" FROM embeddings),
cut AS (SELECT e.*, idx - CAST(floor(start * 32) AS BIGINT) AS pos, ch1 AS value, count(*) OVER (PARTITION BY e.case_id, start) AS n,
  CAST(floor("end" * 32) AS BIGINT) - CAST(floor(start * 32) AS BIGINT) AS want
  FROM ep e JOIN samples s ON e.case_id = s.case_id AND idx >= CAST(floor(start * 32) AS BIGINT) AND idx < CAST(floor("end" * 32) AS BIGINT))"""


def epoch_values(s, d, complete):
    out = P.epoch_samples(epoch_table(s, d), blocks(s, d), FS, BLOCK, 1, complete)
    flat = out.select("case_id", "start", "end", F.posexplode("eeg").alias("pos", "value"))
    return _r(flat.withColumn("pos", F.col("pos").cast("long")), "value", "end")


def anestart(s, d):
    return I.cohort(s, d).select("case_id", F.pmod("anestart", F.lit(30.0)).alias("anestart"))


SEGMENTS = I.SAMPLES + f""", {I.COHORT}, len AS (SELECT case_id, count(*) AS n FROM samples GROUP BY 1),
an AS (SELECT case_id, anestart - 30 * floor(anestart / 30) AS anestart FROM cohort),
seg1 AS (SELECT case_id, unnest(range(room // 16 + 1)) * 16 AS segment_start FROM (SELECT case_id, least(CAST(floor(anestart * 32) AS BIGINT), n) - 64 AS room FROM an JOIN len USING (case_id)) WHERE room >= 0)"""


def experiments(s, d):
    """A sample of 100 vectors per class and experiment, from which the z-scores are taken."""
    e = features_base(s, d).withColumn("experiment", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    picked = take_random(e, ["experiment", "label"], "exp", ["experiment", "start"], F.lit(100))
    return G.zscore_columns(e, ["m", "v"], picked, ["experiment"])


def features_base(s, d):
    return I.epoch_signals(s, d).select("case_id", "start", "end", "label", F.element_at("eeg", 1).alias("m"), F.element_at("eeg", 2).alias("v"))


QUERIES = {
    "d3_epoch_samples": (
        lambda s, d: epoch_values(s, d, False), f"""WITH {EPOCHS} SELECT case_id, start, round("end", 6) AS "end", pos, round(value, 6) AS value FROM cut"""),
    "c8_complete_segments": (
        lambda s, d: epoch_values(s, d, True), f"""WITH {EPOCHS} SELECT case_id, start, round("end", 6) AS "end", pos, round(value, 6) AS value FROM cut WHERE n = want"""),
    "i5_sliding_segments": (
        lambda s, d: P.sliding_segments(anestart(s, d), G.track_lengths(blocks(s, d)), FS, 64, 0.75),
        f"WITH {SEGMENTS} SELECT case_id, segment_start, segment_start + 64 AS segment_end, 1 AS label FROM seg1"),
    "i5_fixed_segments": (
        lambda s, d: P.fixed_segments(epoch_table(s, d), G.track_lengths(blocks(s, d)), FS, 64),
        f"""WITH {EPOCHS}, len AS (SELECT case_id, count(*) AS n FROM samples GROUP BY 1)
        SELECT e.case_id, CAST(floor(start * 32) AS BIGINT) AS segment_start, CAST(floor(start * 32) AS BIGINT) + 64 AS segment_end, 0 AS label
        FROM ep e JOIN len USING (case_id) WHERE CAST(floor(start * 32) AS BIGINT) + 64 <= n"""),
    "j1_zero_phase_band_pass": (lambda s, d: _flat(G.filter_waveform(blocks(s, d), FS, BLOCK, 2.0, 12.0, 4)), None),
    "j2_mean_centring": (
        lambda s, d: _flat(G.centre_waveform(blocks(s, d))),
        f"WITH {I.SAMPLES} SELECT case_id, idx, round(ch1 - avg(ch1) OVER w, 6) AS ch1, round(ch2 - avg(ch2) OVER w, 6) AS ch2 FROM samples WINDOW w AS (PARTITION BY case_id)"),
    "j3_zscore_waveform": (
        lambda s, d: _flat(G.normalize_waveform(blocks(s, d), "zscore")),
        f"""WITH {I.SAMPLES}, st AS (SELECT case_id, avg(v) AS m, stddev_pop(v) AS sd FROM (SELECT case_id, ch1 AS v FROM samples UNION ALL SELECT case_id, ch2 FROM samples) GROUP BY 1)
        SELECT case_id, idx, round((ch1 - m) / sd, 6) AS ch1, round((ch2 - m) / sd, 6) AS ch2 FROM samples JOIN st USING (case_id)"""),
    "j3_tanh_zscore_waveform": (
        lambda s, d: _flat(G.normalize_waveform(blocks(s, d), "tanh_zscore")),
        f"""WITH {I.SAMPLES}, st AS (SELECT case_id, avg(v) AS m, stddev_pop(v) AS sd FROM (SELECT case_id, ch1 AS v FROM samples UNION ALL SELECT case_id, ch2 FROM samples) GROUP BY 1)
        SELECT case_id, idx, round(tanh((ch1 - m) / sd), 6) AS ch1, round(tanh((ch2 - m) / sd), 6) AS ch2 FROM samples JOIN st USING (case_id)"""),
    "j3_minmax_waveform": (
        lambda s, d: _flat(G.normalize_waveform(blocks(s, d), "minmax")),
        f"""WITH {I.SAMPLES}, st AS (SELECT case_id, least(min(ch1), min(ch2)) AS lo, greatest(max(ch1), max(ch2)) AS hi FROM samples GROUP BY 1)
        SELECT case_id, idx, round((ch1 - lo) / (hi - lo), 6) AS ch1, round((ch2 - lo) / (hi - lo), 6) AS ch2 FROM samples JOIN st USING (case_id)"""),
    "j3_quantile_waveform": (
        lambda s, d: _flat(G.normalize_waveform(blocks(s, d), "quantile", BLOCK)),
        f"""WITH {I.SAMPLES}, l AS (SELECT case_id, idx, 1 AS c, ch1 AS v FROM samples UNION ALL SELECT case_id, idx, 2, ch2 FROM samples),
        r AS (SELECT *, (rank() OVER (PARTITION BY case_id ORDER BY v) - 1 + (count(*) OVER (PARTITION BY case_id, v) - 1) / 2) / (count(*) OVER (PARTITION BY case_id) - 1) AS q FROM l)
        SELECT case_id, idx, round(max(q) FILTER (c = 1), 6) AS ch1, round(max(q) FILTER (c = 2), 6) AS ch2 FROM r GROUP BY 1, 2"""),
    "j3_log_waveform": (
        lambda s, d: _flat(G.normalize_waveform(G.to_blocks(I.samples(s, d).withColumn("ch1", F.abs("ch1")).withColumn("ch2", F.abs("ch2")), FS, BLOCK), "log")),
        f"WITH {I.SAMPLES} SELECT case_id, idx, round(ln(1 + abs(ch1)), 6) AS ch1, round(ln(1 + abs(ch2)), 6) AS ch2 FROM samples"),
    "j3_clip_waveform": (
        lambda s, d: _flat(G.normalize_waveform(blocks(s, d), "clip", feature_type="kurtosis")),
        f"WITH {I.SAMPLES} SELECT case_id, idx, round(least(greatest(ch1, 0), 10), 6) AS ch1, round(least(greatest(ch2, 0), 10), 6) AS ch2 FROM samples"),
    "j4_zscore_features": (
        lambda s, d: _r(G.zscore_columns(I.labelled(s, d).select(*KEYS, "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice"),
        f"""WITH {I.LABELLED} SELECT case_id, start, "end", round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
        round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM labelled"""),
    "j5_zscore_by_sample": (
        lambda s, d: _r(experiments(s, d), "m", "v"),
        f"""WITH {I.SIGNALS}, e AS (SELECT case_id, start, "end", label, eeg[1] AS m, eeg[2] AS v, experiment FROM signals, range(3) r(experiment)),
        p AS (SELECT *, row_number() OVER (PARTITION BY experiment, label ORDER BY md5('exp:' || experiment || ':' || start), start) AS rn FROM e),
        st AS (SELECT experiment, avg(m) AS mm, stddev_pop(m) AS sm, avg(v) AS mv, stddev_pop(v) AS sv FROM p WHERE rn <= 100 GROUP BY 1)
        SELECT case_id, start, "end", label, round((m - mm) / sm, 6) AS m, round((v - mv) / sv, 6) AS v, CAST(experiment AS INT) AS experiment FROM e JOIN st USING (experiment)"""),
    "j6_deviation_from_centre": (
        lambda s, d: I.features(s, d).select(*KEYS, F.round(X.deviation_from_center(F.col("l_quantity"), 1, 50), 6).alias("deviation")),
        f"""WITH {I.FEATURES} SELECT case_id, start, "end", round(2 * abs(l_quantity - 25.5) / 49, 6) AS deviation FROM feats"""),
    "j7_rescale_and_tanh": (
        lambda s, d: I.features(s, d).select(*KEYS, F.round(X.rescale_range(F.col("l_quantity"), 1, 50, -1, 1), 6).alias("rescaled"),
                                             F.round(X.scaled_tanh(F.col("l_quantity"), 25, 10, 0, 1), 6).alias("squashed")),
        f"""WITH {I.FEATURES} SELECT case_id, start, "end", round(-1 + 2.0 / 49 * (l_quantity - 1), 6) AS rescaled, round(0.5 * (tanh((l_quantity - 25) / 10) + 1), 6) AS squashed FROM feats"""),
    "j8_welch_epoch_spectra": (
        lambda s, d: _r(G.long_spectra(spectra(s, d)), "psd", n=8),
        f"""WITH {WELCH} SELECT case_id, start, "end", f::DOUBLE AS freq_hz, round(p, 8) AS psd FROM welch"""),
    "j9_welch_track_spectra": (
        lambda s, d: _r(G.track_spectrum(blocks(s, d), FS, BLOCK, 2, SEG), "psd", n=8),
        f"""WITH {I.SAMPLES}, len AS (SELECT case_id, count(*) AS n FROM samples GROUP BY 1),
        segs AS (SELECT s.case_id, g, idx - g * 8 AS i, ch2 AS x FROM samples s JOIN len USING (case_id), (VALUES (0), (1)) o(o), LATERAL (SELECT idx // 8 - o AS g) WHERE g >= 0 AND g * 8 + 16 <= n),
        cent AS (SELECT *, (x - avg(x) OVER (PARTITION BY case_id, g)) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) AS y FROM segs),
        dft AS (SELECT case_id, g, k, sum(y * cos(2 * pi() * k * i / 16)) AS re, sum(y * sin(2 * pi() * k * i / 16)) AS im FROM cent, range(9) r(k) GROUP BY ALL),
        wsum AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 16), 2)) AS w2 FROM range(16) r(i))
        SELECT case_id, (k * 2.0)::DOUBLE AS freq_hz, round(avg((re * re + im * im) / (32 * w2) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END), 8) AS psd FROM dft, wsum GROUP BY 1, 2"""),
    "j10_raw_and_filtered_spectra": (
        lambda s, d: _stage_spectra(s, d), None),
    "k1_band_power": (lambda s, d: _r(features(s, d, ["bandpower"]), *X.BANDS), f"WITH {_bands('0.5, 30')}{BANDPOWER}"),
    "k1_band_power_total": (
        lambda s, d: _r(features(s, d, ["bandpower"], {"bandpower": {"normalize_to": "total"}}), *X.BANDS), f"WITH {_bands('-1, 99')}{BANDPOWER}"),
    "k2_shannon_entropy": (
        lambda s, d: _r(features(s, d, ["shannon_entropy"], {"shannon_entropy": {"normalize": True}}), "shannon_entropy"),
        f"""WITH {MOMENT} SELECT case_id, start, "end", round(-sum(q * log2(q)) / log2(count(*)), 6) AS shannon_entropy FROM mu WHERE q > 0 GROUP BY ALL"""),
    "k3_spectral_skewness": (
        lambda s, d: _r(features(s, d, ["spectral_skewness"]), "spectral_skewness"),
        f"""WITH {MOMENT} SELECT case_id, start, "end", round(sum(q * pow(f - m, 3)) / pow(sqrt(sum(q * pow(f - m, 2))), 3), 6) AS spectral_skewness FROM mu GROUP BY ALL"""),
    "k4_spectral_kurtosis": (
        lambda s, d: _r(features(s, d, ["spectral_kurtosis"]), "spectral_kurtosis"),
        f"""WITH {MOMENT} SELECT case_id, start, "end", round(sum(q * pow(f - m, 4)) / pow(sqrt(sum(q * pow(f - m, 2))), 4), 6) AS spectral_kurtosis FROM mu GROUP BY ALL"""),
    "k3_k4_bounded": (
        lambda s, d: _r(features(s, d, ["spectral_skewness", "spectral_kurtosis"], {"spectral_skewness": {"normalize": True, "n_method": "tanh"}, "spectral_kurtosis": {"normalize": True, "upper_bound": 2}}),
                        "spectral_skewness", "spectral_kurtosis"),
        f"""WITH {MOMENT}, z AS (SELECT case_id, start, "end", sum(q * pow(f - m, 3)) / pow(sqrt(sum(q * pow(f - m, 2))), 3) AS s, sum(q * pow(f - m, 4)) / pow(sqrt(sum(q * pow(f - m, 2))), 4) AS k FROM mu GROUP BY ALL)
        SELECT case_id, start, "end", round((tanh(s) + 1) / 2, 6) AS spectral_skewness, round(least(greatest(k, 0), 2)::DOUBLE, 6) AS spectral_kurtosis FROM z"""),
    "k5_k6_k7_time_features": (
        lambda s, d: _r(G.extract_features(I.epoch_signals(s, d), ["mean", "variance", "amplitude"]), "mean", "variance", "amplitude", n=8),
        f"""WITH {FLAT} SELECT case_id, start, "end", round(avg(x), 8) AS mean, round(var_pop(x), 8) AS variance, round(max(x) - min(x), 8) AS amplitude FROM flat GROUP BY ALL"""),
    "k8_sample_entropy": (
        lambda s, d: _r(G.extract_features(I.epoch_signals(s, d), ["sample_entropy"]), "sample_entropy"),
        f"""WITH {PAIRS}, n AS (SELECT l.case_id, l.start, l."end", count(*) FILTER (abs(l.a - u.a) < r AND abs(l.b - u.b) < r) AS b,
          count(*) FILTER (abs(l.a - u.a) < r AND abs(l.b - u.b) < r AND abs(l.c - u.c) < r) AS a
          FROM t3 l JOIN t3 u ON l.start = u.start AND l.pos < u.pos JOIN sd ON sd.start = l.start GROUP BY ALL)
        SELECT case_id, start, "end", round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END, 6) AS sample_entropy FROM n"""),
    "k9_permutation_entropy": (
        lambda s, d: _r(G.extract_features(I.epoch_signals(s, d), ["permutation_entropy"], overrides={"permutation_entropy": {"normalize": True}}), "permutation_entropy"),
        f"""WITH {PAIRS}, c AS (SELECT case_id, start, "end", (a <= b)::INT * 4 + (a <= c)::INT * 2 + (b <= c)::INT AS code, count(*) AS n FROM t3 GROUP BY ALL)
        SELECT case_id, start, "end", round(-sum(n / 62 * log2(n / 62)) / log2(6), 6) AS permutation_entropy FROM c GROUP BY ALL"""),
    "k10_fuzzy_entropy": (
        lambda s, d: _r(G.extract_features(I.epoch_signals(s, d), ["fuzzy_entropy"]), "fuzzy_entropy"),
        f"""WITH {PAIRS}, c AS (SELECT *, (a + b) / 2 AS m2, (a + b + c) / 3 AS m3 FROM t3),
        n AS (SELECT l.case_id, l.start, l."end",
          sum(exp(-pow(greatest(abs(l.a - l.m2 - u.a + u.m2), abs(l.b - l.m2 - u.b + u.m2)), 2) / r)) AS p2,
          sum(exp(-pow(greatest(abs(l.a - l.m3 - u.a + u.m3), abs(l.b - l.m3 - u.b + u.m3), abs(l.c - l.m3 - u.c + u.m3)), 2) / r)) AS p3
          FROM c l JOIN c u ON l.start = u.start AND l.pos <> u.pos JOIN sd ON sd.start = l.start GROUP BY ALL)
        SELECT case_id, start, "end", round(ln(p2 / p3), 6) AS fuzzy_entropy FROM n"""),
    "k11_waveform_epoch_features": (
        lambda s, d: _r(G.extract_features(P.epoch_samples(epoch_table(s, d), blocks(s, d), FS, BLOCK, 1, True), ["mean", "variance", "amplitude"]), "end", "mean", "variance", "amplitude"),
        f"""WITH {EPOCHS} SELECT case_id, start, round("end", 6) AS "end", round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(max(value) - min(value), 6) AS amplitude
        FROM cut WHERE n = want GROUP BY case_id, start, "end\""""),
    "k12_o1_all_registered_features": (lambda s, d: features(s, d, list(X.FEATURES)), None),
}


def _stage_spectra(s, d):
    b = blocks(s, d)
    return G.compare_stages(b, materialize(G.filter_waveform(b, FS, BLOCK, 2.0, 12.0, 4), "filtered_wave"), FS, BLOCK, 1, SEG)
