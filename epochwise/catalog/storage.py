"""Readers and writers: tables are written in the source layouts below the shared folder and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from epochwise import params as PM
from epochwise.catalog import inputs as I
from epochwise.catalog import mining as MI
from epochwise.catalog import signals as SG
from epochwise.catalog.inputs import BLOCK, FS
from epochwise.operators import reports as R
from epochwise.operators import signal as G
from epochwise.plans import runs as N
from epochwise.functions.features import FEATURES
from epochwise.plans.staged import staged_run
from epochwise.sources import readers as A
from epochwise.sources import writers as B
from epochwise.session import load, materialize, new_path, spread

FOLDER = r"case_id=(\d+)/"
K = 'case_id, start, "end"'
PARTS = 8


def _r(df, *cols, n=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def _plus_zero(df):
    """Minus zero as zero: the two engines round tiny negative numbers to different zeros."""
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in ("ch1", "ch2")})


def _by_case(df, order):
    """Files in case and row order; a long case spreads over several files."""
    return df.repartitionByRange(PARTS, "case_id", order).sortWithinPartitions("case_id", order)


def stored_tracks(s, d):
    path = new_path(s, "tracks_csv")
    t = I.tracks(s, d).select("case_id", F.col("time").alias("Time"), F.col("bis").alias("BIS_BIS"), F.col("bis_sr").alias("BIS_SR"), F.col("mac").alias("Primus_MAC"))
    _by_case(t, "Time").write.partitionBy("case_id").csv(path, header=True)
    return path


def tracks_scan(s, d):
    return _r(A.read_tracks(s, stored_tracks(s, d), FOLDER, chunk_seconds=I.CHUNK_HOURS).drop("chunk"), "time")


def waveform_csv(s, d):
    path = new_path(s, "wave_csv")
    w = I.samples(s, d).withColumn("BIS/EEG1_WAV", F.when(F.col("idx") % 10 != 3, F.col("ch1"))).withColumn("BIS/EEG2_WAV", F.col("ch2"))
    _by_case(w.select("case_id", "idx", "BIS/EEG1_WAV", "BIS/EEG2_WAV"), "idx").drop("idx").write.partitionBy("case_id").csv(path, header=True)
    return _r(A.read_waveform_csv(s, path, FOLDER, fs=FS), "ch1", "ch2")


def filtered_csv(s, d):
    path = new_path(s, "filtered_csv")
    line = F.concat_ws(",", F.round("ch1", 4).cast("string"), F.round("ch2", 4).cast("string"))
    data = I.samples(s, d).select("case_id", "idx", line.alias("value"))
    heads = data.select("case_id").distinct().select("case_id", F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("idx"), F.lit(f"# fs = {FS}").alias("value")), F.struct(F.lit(-1).cast("long").alias("idx"), F.lit("1,2").alias("value")))).alias("h")).select("case_id", "h.*")
    _by_case(data.unionByName(heads), "idx").drop("idx").write.partitionBy("case_id").text(path)
    return _plus_zero(A.read_filtered_csv(s, path, FOLDER))


def stages(s, d):
    path = new_path(s, "waveform")
    b = SG.blocks(s, d)
    B.write_waveform(b, path, "raw")
    B.write_waveform(G.centre_waveform(b), path, "filtered", decimals=None)
    return path


def raw_stage(s, d):
    return _plus_zero(G.to_samples(A.read_waveform(s, stages(s, d), "raw"), BLOCK))


def filtered_stage(s, d):
    path = new_path(s, "waveform32")
    B.write_waveform(A.read_waveform(s, stages(s, d), "filtered"), path, "filtered", float32=True)
    f = A.read_waveform(s, path, "filtered")
    wide = G.to_samples(f, BLOCK).select("case_id", "idx", F.col("ch1").cast("double").alias("ch1"), F.col("ch2").cast("double").alias("ch2"))
    return _plus_zero(_r(wide, "ch1", "ch2", n=4))


def epoch_table(s, d):
    path = new_path(s, "epochs")
    from epochwise.operators import episodes as E

    e = materialize(E.detect_episodes(MI._filled(s, d), [(20.0, 0.1)], [2, 3], [5.0]), "episodes")
    w = E.cut_windows(e, [5, 10], [0.0])
    for size in (5, 10):
        for m in (2, 3):
            p = PM.EpisodeParams(20, 0.1, m, 5, False, size, 0.0)
            B.write_epochs(w.filter((F.col("fixed_window") == size) & (F.col("min_episode_length") == m)).select("case_id", "start", "end"), path, p)
    return A.read_epochs(s, path, PM.EpisodeParams(20, 0.1, 3, 5, False, 10, 0.0))


def cohort_csv(s, d):
    path = new_path(s, "cohort")
    c = load(s, d, "customer").select(F.col("c_custkey").alias("caseid"), F.col("c_acctbal").alias("anestart"), F.col("c_mktsegment").alias("sex"))
    c.write.csv(path, header=True)
    return A.read_cohort(s, path, "caseid long, anestart double, sex string")


def spectra_files(s, d):
    path = new_path(s, "spectra_csv")
    name = F.concat_ws("_", F.lit("PSD"), "start", "end", "case_id").alias("_f")
    epochs = SG.spectra(s, d)
    sp = G.long_spectra(epochs).select(F.col("freq_hz").alias("Frequency_Hz"), F.col("psd").alias("PSD_V2_per_Hz"), name)
    B.write_spectrum_files(sp, path, "_f", epochs.count())
    return _r(A.read_spectra(s, path), "psd", n=8)


def predictions_path(s, d):
    path = new_path(s, "predictions")
    p = I.labelled(s, d).select("case_id", "start", "end", "label", "prediction", "fold")
    B.write_predictions(p, path, "first")
    B.write_predictions(p.withColumn("prediction", 1 - F.col("prediction")), path, "second")
    return path


def fold_results(s, d):
    return A.read_predictions(s, predictions_path(s, d), "first").withColumn("fold", F.col("fold").cast("long"))


def feature_pair(s, d):
    path = new_path(s, "feature_sets")
    f = I.labelled(s, d).select("case_id", "start", "end", "l_quantity", "label")
    B.write_feature_set(f.filter("label = 1").drop("label"), path, "awake")
    B.write_feature_set(f.filter("label = 0").drop("label"), path, "faw")
    a, b = A.read_feature_pair(s, path, "awake", "faw")
    return a.withColumn("class", F.lit("awake")).unionByName(b.withColumn("class", F.lit("faw")))


def case_list(s, d):
    return A.list_cases(s, stored_tracks(s, d), FOLDER)


def registered(s, d):
    """A run recorded with its folds; returns the path and the name."""
    path = new_path(s, "registry")
    lab = I.labelled(s, d)
    settings = N.RunSettings(["faw", "awake"], {"svm": {"C": 1, "kernel": "rbf"}}, range(3), {"bis_threshold": 70})
    splits = lab.withColumn("role", F.when(F.col("start") % 4 == 0, "test").otherwise("train"))
    name = N.register_run(s, path, settings, splits, R.fold_metrics(lab), "first", now=datetime(2024, 1, 1))
    return path, name, settings


def run_cases(s, d):
    path, name, _ = registered(s, d)
    A.read_run(N.read_runs(s, path), name)
    return A.run_cases(s.read.parquet(f"{path}/split_keys"), name)


def run_folds(s, d):
    path, name, _ = registered(s, d)
    return A.run_folds(s.read.parquet(f"{path}/split_keys"), name)


def registry(s, d):
    """Second run forced: same parameters, same wished name."""
    path, _, settings = registered(s, d)
    lab = I.labelled(s, d)
    N.register_run(s, path, settings, lab.withColumn("role", F.lit("train")), R.fold_metrics(lab), "first", True, datetime(2024, 1, 2))
    runs = N.read_runs(s, path)
    schema = "array<struct<fold:bigint,true_1_pred_1:bigint>>"
    return runs.select("run_name", "created", "model", (F.sha2("params", 256) == F.col("param_hash")).alias("hash_ok"),
                       F.aggregate(F.from_json("metrics", schema), F.lit(0).cast("long"), lambda a, m: a + m.true_1_pred_1).alias("hits"))


def analysis_csv(s, d):
    path = new_path(s, "analysis") + ".csv"
    B.write_table(s, R.error_by_group(I.judged(s, d), ["source"]), path)
    return _r(A.read_analysis(s, path, "source string, total_samples long, incorrect_predictions long, error_rate double"), "error_rate")


def analysis_json(s, d):
    path = new_path(s, "analysis") + ".json"
    row = R.fold_metrics(I.judged(s, d), []).select("accuracy", "precision", "recall", "f1").first()
    B.write_table(s, row.asDict(), path)
    return A.read_analysis(s, path, "accuracy double, f1 double, precision double, recall double")


def spectra_sink(s, d):
    path = new_path(s, "spectra")
    sp = G.long_spectra(SG.spectra(s, d))
    B.write_spectra(sp.limit(5), path)
    B.write_spectra(sp, path)
    return _r(s.read.parquet(path).filter("tag = 'epoch'").drop("tag"), "psd", n=8)


def feature_sink(s, d):
    path = new_path(s, "features")
    e = I.epoch_signals(s, d)
    for kind, label in (("awake", 1), ("faw", 0)):
        B.write_feature(G.extract_features(e.filter(F.col("label") == label), ["variance"]), path, "variance", kind)
    return _r(s.read.parquet(f"{path}/variance"), "variance", n=8)


def split_sink(s, d):
    path = new_path(s, "splits")
    lab = I.labelled(s, d).select("case_id", "start", "end", "label")
    each = lab.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("role", F.when(F.col("case_id") % 2 == F.col("fold"), "test").otherwise("train"))
    B.write_splits(each, path)
    return s.read.parquet(path).withColumn("fold", F.col("fold").cast("long"))


def append_unique(s, d):
    path = new_path(s, "outliers")
    o = I.labelled(s, d).filter("error = 1").select("case_id", "start", "end")
    B.append_unique(o.filter("start % 3 <> 0"), path)
    new, n = B.append_unique(o.filter("start % 2 = 0").unionByName(o.filter("start % 2 = 0")), path)
    return new.withColumn("n_new", F.lit(n).cast("long"))


def segments(s, d):
    path = new_path(s, "segments")
    e = I.epoch_signals(s, d).drop("end")
    B.write_segments(e, path, 64)
    m = s.read.parquet(path)
    return m.select("case_id", "start", "label", F.round("eeg_0", 6).alias("eeg_0"), F.round("eeg_63", 6).alias("eeg_63"), F.lit(len(m.columns)).alias("n_columns"))


def summary_modes(s, d):
    path = new_path(s, "summary")
    lab = I.labelled(s, d)
    B.write_summary(R.error_by_group(lab, ["case_id"]), path)
    B.write_summary(R.error_by_group(lab.filter("label = 1"), ["case_id"]), path, no_overwrite=True)
    return _r(s.read.parquet(path), "error_rate")


def codes(s, d):
    """Parameter codes written and parsed, for the parameter sets in the episode table."""
    e = MI.episodes(s, d)
    p = e.groupBy("bis_threshold", "mac_threshold", "min_episode_length", "refractory_time").agg(F.count(F.lit(1)).alias("n"))
    c = p.withColumn("code", PM.code_column("result", F.col("bis_threshold"), F.col("mac_threshold"), F.col("min_episode_length"), F.col("refractory_time")))
    return c.select("code", "n", PM.parse_code_column(F.col("code")).alias("p")).select("code", "n", "p.*")


def staged(s, d):
    """All seven steps on the embedding waveforms with all features; epochs of two seconds, class by label; scaled by the training rows."""
    b = SG.blocks(s, d)
    e = load(s, d, "embeddings").select((F.col("vec_id") % 40).alias("case_id"), (F.floor(F.col("vec_id") / 40) * 2.0).alias("start"), (F.col("label") >= 5).alias("up"))
    e = e.withColumn("end", F.col("start") + 2.0)
    kinds = {"awake": e.filter("up").drop("up"), "faw": e.filter("not up").drop("up")}
    t = staged_run(b, kinds, list(FEATURES), fs=FS, block_len=BLOCK, low=2.0, high=12.0, segment_seconds=SG.SEG, test_size=0.4, model={"kernel": "linear"}, fit_on="train")
    return t["reports"]["error_label_by_fold"]


_INTER = I.SAMPLES + """, g AS (SELECT case_id, idx, CASE WHEN idx % 10 <> 3 THEN ch1 END AS ch1, ch2 FROM samples), a AS (SELECT *,
  last_value(CASE WHEN ch1 IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS p, last_value(ch1 IGNORE NULLS) OVER w AS pv,
  first_value(CASE WHEN ch1 IS NOT NULL THEN idx END IGNORE NULLS) OVER x AS n, first_value(ch1 IGNORE NULLS) OVER x AS nv FROM g
  WINDOW w AS (PARTITION BY case_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY case_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT case_id, idx, round(coalesce(ch1, CASE WHEN p IS NULL THEN nv WHEN n IS NULL THEN pv ELSE pv + (nv - pv) * ((idx - p) / (n - p)) END), 6) AS ch1, round(ch2, 6) AS ch2, 32 AS fs FROM a"""
_LAB = f"WITH {I.LABELLED} "

QUERIES = {
    "a1_track_scan": (tracks_scan, f"WITH {I.TRACKS} SELECT case_id, row_idx, round(time, 6) AS time, bis, bis_sr, mac FROM tracks"),
    "a2_waveform_scan": (waveform_csv, f"WITH {_INTER}"),
    "a3_filtered_waveform_scan": (filtered_csv, f"WITH {I.SAMPLES} SELECT case_id, idx, round(ch1, 4) + 0.0 AS ch1, round(ch2, 4) + 0.0 AS ch2, 32 AS fs FROM samples"),
    "a4_b1_raw_stage": (raw_stage, f"WITH {I.SAMPLES} SELECT case_id, idx, round(ch1, 4) + 0.0 AS ch1, round(ch2, 4) + 0.0 AS ch2 FROM samples"),
    "a4_b1_filtered_stage_float": (
        filtered_stage, f"WITH {I.SAMPLES} SELECT case_id, idx, round(ch1 - avg(ch1) OVER w, 4) + 0.0 AS ch1, round(ch2 - avg(ch2) OVER w, 4) + 0.0 AS ch2 FROM samples WINDOW w AS (PARTITION BY case_id)"),
    "a5_epoch_table_by_parameters": (
        epoch_table, f"""WITH {MI.EPISODES}, {MI._windows_sql("episodes")} SELECT {K} FROM windows WHERE bis_threshold = 20 AND mac_threshold = 0.1 AND min_episode_length = 3
        AND refractory_time = 5 AND fixed_window = 10 AND overlap_frac = 0"""),
    "a6_cohort_scan": (cohort_csv, "SELECT c_custkey AS case_id, c_acctbal AS anestart, c_mktsegment AS sex FROM customer"),
    "a7_spectrum_scan": (spectra_files, f"""WITH {SG.WELCH} SELECT {K}, f::DOUBLE AS freq_hz, round(p, 8) AS psd FROM welch"""),
    "a8_b7_fold_results": (fold_results, _LAB + f"SELECT {K}, label, prediction, fold, error FROM labelled"),
    "a9_b4_feature_pair": (feature_pair, _LAB + f"SELECT {K}, l_quantity, CASE label WHEN 1 THEN 'awake' ELSE 'faw' END AS class FROM labelled"),
    "a10_case_listing": (case_list, f"WITH {I.TRACKS} SELECT DISTINCT case_id FROM tracks"),
    "a11_run_cases": (run_cases, _LAB + "SELECT DISTINCT case_id FROM labelled"),
    "a11_run_folds": (run_folds, _LAB + "SELECT fold, CASE WHEN start % 4 = 0 THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM labelled GROUP BY ALL"),
    "a12_b10_analysis_csv": (analysis_csv, f"WITH {I.JUDGED} SELECT source, count(*) AS total_samples, CAST(sum(error) AS BIGINT) AS incorrect_predictions, round(sum(error) / count(*), 6) AS error_rate FROM judged GROUP BY 1"),
    "a12_b10_analysis_json": (
        analysis_json, f"""WITH {I.JUDGED}, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
        count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) AS n, sum(error) AS e FROM judged)
        SELECT round(1 - e / n, 4) AS accuracy, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c"""),
    "b2_spectrum_sink": (spectra_sink, f"WITH {SG.WELCH} SELECT {K}, f::DOUBLE AS freq_hz, round(p, 8) AS psd FROM welch"),
    "b3_feature_sink": (feature_sink, f"WITH {SG.FLAT} SELECT {K}, round(var_pop(x), 8) AS variance, CASE label WHEN 1 THEN 'awake' ELSE 'faw' END AS epoch_type FROM flat GROUP BY case_id, start, \"end\", label"),
    "b5_split_sink": (split_sink, _LAB + f"SELECT {K}, label, f AS fold, CASE WHEN case_id % 2 = f THEN 'test' ELSE 'train' END AS role, 2::BIGINT AS n_folds FROM labelled, range(2) r(f)"),
    "b8_append_unique": (
        append_unique, _LAB + f", n AS (SELECT {K} FROM labelled WHERE error = 1 AND start % 2 = 0 AND start % 3 = 0) SELECT *, (SELECT count(*) FROM n) AS n_new FROM n"),
    "b9_segment_matrix": (segments, f"WITH {I.SIGNALS} SELECT case_id, start, label, round(eeg[1], 6) AS eeg_0, round(eeg[64], 6) AS eeg_63, 67 AS n_columns FROM signals"),
    "b11_summary_no_overwrite": (summary_modes, _LAB + "SELECT case_id, count(*) AS total_samples, CAST(sum(error) AS BIGINT) AS incorrect_predictions, round(sum(error) / count(*), 6) AS error_rate FROM labelled GROUP BY 1"),
    "b12_run_registry": (
        registry, _LAB + """, h AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS hits FROM labelled)
        SELECT 'first' AS run_name, '2024-01-01 00:00:00' AS created, 'svm' AS model, true AS hash_ok, hits FROM h
        UNION ALL SELECT 'first_2024_01_02T00_00_00', '2024-01-02 00:00:00', 'svm', true, hits FROM h"""),
    "n1_staged_run": (staged, None),
    "n3_parameter_codes": (
        codes, f"""WITH {MI.EPISODES}, c AS (SELECT bis_threshold, mac_threshold, min_episode_length, refractory_time, count(*) AS n FROM episodes GROUP BY ALL)
        SELECT 'result_' || CAST(bis_threshold AS INT) || '_' || replace(printf('%.2f', mac_threshold), '.', '') || '_' || min_episode_length || '_' || CAST(refractory_time AS INT) AS code, n,
        bis_threshold, mac_threshold, CAST(min_episode_length AS BIGINT) AS min_episode_length, refractory_time FROM c"""),
}
