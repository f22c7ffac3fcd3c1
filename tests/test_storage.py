"""Readers and writers on small files in the source layouts."""

import pytest
from pyspark.sql import functions as F

from epochwise.params import EpisodeParams
from epochwise.plans.runs import RunSettings, read_runs, register_run
from epochwise.sources import readers as A
from epochwise.sources import writers as B


def test_tracks(spark, tmp_path):
    (tmp_path / "7.csv").write_text("Time,BIS_BIS,BIS_SR,Primus_MAC\n0,NaN,0,\n1,80,0,0.9\n")
    (tmp_path / "12.csv").write_text("Time,BIS_BIS,BIS_SR,Primus_MAC\n0,50,1,NaN\n")
    (tmp_path / "notes.csv").write_text("Time,BIS_BIS,BIS_SR,Primus_MAC\n")
    got = A.read_tracks(spark, str(tmp_path)).orderBy("case_id", "row_idx").collect()
    assert [(r["case_id"], r["row_idx"], r["bis"], r["mac"]) for r in got] == [(7, 0, None, None), (7, 1, 80.0, 0.9), (12, 0, 50.0, None)]
    assert sorted(r["case_id"] for r in A.list_cases(spark, str(tmp_path)).collect()) == [7, 12]


def test_waveform_rows_keep_file_order_over_many_splits(spark, tmp_path):
    n = 4001
    (tmp_path / "3.csv").write_text("BIS/EEG1_WAV,BIS/EEG2_WAV\n" + "".join(f"{'NaN' if i % 7 == 2 else i},{-i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = A.read_waveform_csv(spark, str(tmp_path)).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["idx"] for r in got] == list(range(n))
    assert [r["ch1"] for r in got] == pytest.approx([float(i) for i in range(n)])
    assert got[0]["fs"] == 128


@pytest.mark.parametrize("head,ok", [("# fs = 128\n", True), ("", False), ("# fs: 128\n", False), ("# fs = x\n", False)])
def test_sampling_rate_header(spark, tmp_path, head, ok):
    (tmp_path / "5.csv").write_text(head + "1,2\n0.5,1.5\n-1,2e-3\n")
    df = A.read_filtered_csv(spark, str(tmp_path))
    if ok:
        assert [(r["case_id"], r["idx"], r["ch1"], r["ch2"], r["fs"]) for r in df.orderBy("idx").collect()] == [(5, 0, 0.5, 1.5, 128), (5, 1, -1.0, 0.002, 128)]
    else:
        with pytest.raises(Exception, match="sampling rate"):
            df.collect()


def test_spectrum_names(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir()
    bad.mkdir()
    text = "Frequency_Hz,PSD_V2_per_Hz\n0.5,2.0\n"
    (good / "PSD_10_20.0_123.csv").write_text(text)
    (bad / "falsePrefix_1_2_3.csv").write_text(text)
    r = A.read_spectra(spark, str(good)).first()
    assert (r["start"], r["end"], r["case_id"], r["freq_hz"], r["psd"]) == (10, 20, 123, 0.5, 2.0)
    with pytest.raises(Exception, match="not a spectrum file name"):
        A.read_spectra(spark, str(bad)).collect()


def test_spectra_are_written_and_read_in_groups(spark, tmp_path, monkeypatch):
    """The driver holds the files of one job: no job takes all folders, and the rows are those of all of them."""
    from pyspark.sql.readwriter import DataFrameReader

    from epochwise.catalog import signals, storage

    vectors = [(k, [float((k * j) % 7 - 3) for j in range(64)], k % 10) for k in [*range(40), 39]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(B, "FOLDERS", 10, raising=False)
    read, csv = [], DataFrameReader.csv

    def noted(self, path, *a, **k):
        out = csv(self, path, *a, **k)
        read.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(DataFrameReader, "csv", noted)
    got = storage.spectra_files(spark, str(tmp_path))
    assert sum(read) == 40 and max(read) < 30, read
    long = storage.G.long_spectra(signals.spectra(spark, str(tmp_path)))
    want = long.select("case_id", "start", "end", "freq_hz", F.round("psd", 8).alias("psd"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 41 * 9


def test_a_name_beside_groups_is_an_error(spark, tmp_path):
    (tmp_path / "group=0").mkdir()
    text = "Frequency_Hz,PSD_V2_per_Hz\n0.5,2.0\n"
    (tmp_path / "group=0" / "PSD_1_2_3.csv").write_text(text)
    (tmp_path / "_SUCCESS").write_text("")
    assert A.read_spectra(spark, str(tmp_path)).count() == 1
    (tmp_path / "PSD_4_5_6.csv").write_text(text)
    with pytest.raises(ValueError, match="PSD_4_5_6"):
        A.read_spectra(spark, str(tmp_path))


def test_epochs_by_parameters_prune_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 20.0)], "case_id long, start double, end double")
    B.write_epochs(df, str(tmp_path), EpisodeParams())
    B.write_epochs(df.withColumn("case_id", F.lit(2).cast("long")), str(tmp_path), EpisodeParams(overlap=0.25))
    got = A.read_epochs(spark, str(tmp_path), EpisodeParams(overlap=0.25))
    assert [r["case_id"] for r in got.collect()] == [2]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        A.read_epochs(spark, str(tmp_path), EpisodeParams(mac_threshold=0.5))


def test_append_unique(spark, tmp_path):
    path = str(tmp_path / "o")
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, v string")
    assert B.append_unique(df, path)[1] == 2
    new, n = B.append_unique(spark.createDataFrame([(1, None), (3, "b"), (3, "b")], "k int, v string"), path)
    assert n == 1 and [r["k"] for r in new.collect()] == [3]
    assert spark.read.parquet(path).count() == 3


def test_spectrum_sink_checks_keys_and_replaces_its_tag(spark, tmp_path):
    path = str(tmp_path / "s")
    sp = spark.createDataFrame([(1, 0, 2, 0.5, 1.0)], "case_id long, start long, end long, freq_hz double, psd double")
    B.write_spectra(sp, path, "raw")
    B.write_spectra(sp, path, "filtered")
    B.write_spectra(sp.withColumn("psd", F.lit(9.0)), path, "raw")
    assert {(r["tag"], r["psd"]) for r in spark.read.parquet(path).collect()} == {("raw", 9.0), ("filtered", 1.0)}
    with pytest.raises(Exception, match="spectrum without start"):
        B.write_spectra(sp.withColumn("start", F.lit(None).cast("long")), str(tmp_path / "t"))


def test_predictions_and_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 0)], "label int, prediction int")
    B.write_predictions(df, str(tmp_path / "p"), "r")
    got = A.read_predictions(spark, str(tmp_path / "p"), "r").collect()
    assert sorted((r["label"], r["prediction"], r["error"]) for r in got) == [(0, 1, 1), (1, 0, 1), (1, 1, 0)]
    folds = [(1, "train", [0, 1, 2]), (1, "test", [2, 3]), (2, "train", [4, 5]), (2, "test", [6, 7, 3, 5])]
    rows = [(f, r, i) for f, r, ids in folds for i in ids]
    B.write_splits(spark.createDataFrame(rows, "fold int, role string, case_id int"), str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    assert s.filter("fold = 1 and role = 'train'").count() == 3 and s.filter("fold = 2 and role = 'test'").count() == 4
    assert s.first()["n_folds"] == 2


def test_feature_pair_needs_equal_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 1.0, 5.0)], "case_id long, start double, end double, x double")
    B.write_feature_set(df, str(tmp_path), "awake")
    B.write_feature_set(df.withColumnRenamed("x", "y"), str(tmp_path), "faw")
    with pytest.raises(ValueError, match="differ in their columns"):
        A.read_feature_pair(spark, str(tmp_path), "awake", "faw")


def test_run_registry(spark, tmp_path):
    path = str(tmp_path / "r")
    s = RunSettings(["faw", "awake"], {"svm": {"C": 1}}, {3, 1})
    splits = spark.createDataFrame([(0, "test", 1, 0.0, 2.0)], "fold int, role string, case_id long, start double, end double")
    m = spark.createDataFrame([(0, 0.9)], "fold int, accuracy double")
    assert register_run(spark, path, s, splits, m, "a") == "a"
    with pytest.raises(ValueError, match="is stored with these"):
        register_run(spark, path, RunSettings(["awake", "faw"], {"svm": {"C": 1}}, [1, 3]), splits, m, "b")
    assert register_run(spark, path, s, splits, m, "a", force=True).startswith("a_")
    assert register_run(spark, path, RunSettings(["faw", "awake"], {"svm": {"C": 2}}), splits, m, "c") == "c"
    assert A.read_run(read_runs(spark, path), "c").count() == 1
    assert A.read_run(read_runs(spark, path), "c").first()["final_cases"] == [1]
    with pytest.raises(ValueError, match="no run named"):
        A.read_run(read_runs(spark, path), "zzz")
    with pytest.raises(ValueError, match="no kind of epoch"):
        RunSettings(["sleep"], {"svm": {}})


def test_unknown_kinds(spark, tmp_path):
    with pytest.raises(ValueError):
        A.read_analysis(spark, "x.txt")
    with pytest.raises(ValueError):
        B.write_table(spark, [1, 2], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        A.read_waveform(spark, str(tmp_path), "other")


def test_many_small_files_are_few_tasks_and_read_once(spark, tmp_path):
    """A task for every few files, in every pass, took the scans at size beyond their limit."""
    from epochwise.sources import readers

    df = spark.range(300).selectExpr("id AS case_id", "cast(id as double) AS Time", "1.5D AS BIS_BIS", "2.5D AS BIS_SR", "3.5D AS Primus_MAC")
    df.coalesce(1).write.partitionBy("case_id").csv(str(tmp_path / "t"), header=True)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    got = readers.read_tracks(spark, str(tmp_path / "t"), r"case_id=(\d+)/")
    assert not [f for f in got.inputFiles() if f.endswith(".csv")]
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert got.count() == 300 and got.filter("time = case_id and row_idx = 0 and mac = 3.5").count() == 300
