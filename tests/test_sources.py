"""Sources on small files."""

import os

import numpy as np
import pytest

from vitalframe.sources import datasets, waveforms


def test_sigmf_round_trip(spark, tmp_path):
    for name, x in (("a", [1.0, 2.5, -3.0]), ("b", [0.5] * 4)):
        data, meta = waveforms.sigmf_bytes(x, 500.0, file_id=name)
        (tmp_path / f"{name}_wave.sigmf-data").write_bytes(data)
        (tmp_path / f"{name}_wave.sigmf-meta").write_text(meta)
    got = {r["file_id"]: (r["fs"], r["samples"]) for r in waveforms.read_sigmf(spark, str(tmp_path)).collect()}
    assert got == {"a": (500.0, [1.0, 2.5, -3.0]), "b": (500.0, [0.5] * 4)}


@pytest.mark.parametrize("d", [",", ";"])
def test_sweep(spark, tmp_path, d):
    (tmp_path / "s.csv").write_text("device x\nmade today\n" + "mnum,f,Zmag,Zphi,Zim,Zre,satur".replace(",", d) + "\n" + "1,100.5,2,3,4,5,0".replace(",", d) + "\n" + "2,200,x,3,4,5,1".replace(",", d) + "\n\n")
    got = [(r["i"], r["mnum"], r["f"], r["zmag"], r["zre"], r["satur"]) for r in waveforms.read_sweeps(spark, str(tmp_path)).orderBy("i").collect()]
    assert got == [(0, 1, 100.5, 2.0, 5.0, 0), (1, 2, 200.0, None, 5.0, 1)]


def test_signal_csv_and_slices(spark, tmp_path):
    (tmp_path / "x.csv").write_text("f,mag_filtered\n1,0.5\n2,0.75\n3,1\n")
    r = waveforms.read_signal_csv(spark, str(tmp_path)).first()
    assert r["samples"] == [0.5, 0.75, 1.0]
    wave = spark.createDataFrame([("f", [1.0, 2.0, 3.0])], "file_id string, samples array<double>")
    cut = spark.createDataFrame([("f", 1, 9), ("f", -1, 2), ("f", 0, 0)], "file_id string, start_sample long, duration long")
    assert [r["samples"] for r in waveforms.sliced(cut, wave).collect()] == [[2.0, 3.0]]


def test_index_and_config(spark, tmp_path):
    path = str(tmp_path / "x_dataset.csv")
    with open(path, "w") as f:
        f.write("file_id,relative_path,modality,GLC,session_id\nf1,raw/a/b.sigmf-meta,ppg,101.5,S1\nf2,raw/c.csv,ecg,n/a,2\n")
    index = datasets.read_index(spark, path)
    rows = {r["file_id"]: r for r in index.collect()}
    assert rows["f1"]["GLC"] == 101.5 and rows["f2"]["GLC"] is None and rows["f2"]["session_id"] == "2"
    assert datasets.file_id_of(index, "raw/c.csv") == "f2" and datasets.duplicate_ids(index).count() == 0
    with pytest.raises(ValueError):
        datasets.file_id_of(index, "none")
    made = {r[0] for r in index.select(datasets.generated_path("relative_path", "sqi_all", "csv")).collect()}
    assert made == {"sqi_all/a/b_sqi_all.csv", "sqi_all/c_sqi_all.csv"}
    with pytest.warns(UserWarning):
        cfg = datasets.DatasetConfig.load({"DATASET_FILE": path, "SIMULATIONS_OUTPUT_PATH": "/out", "MODALITIES": "ppg, ecg", "ODD": 1})
    assert cfg.modalities == ("ppg", "ecg") and cfg.folder("ml") == "/out/ml"
    with pytest.raises(FileNotFoundError):
        cfg.validate(spark)
    (tmp_path / "raw").mkdir()
    cfg.validate(spark)
    with pytest.raises(KeyError):
        cfg.value("PPG_FS")
    with pytest.raises(ValueError):
        datasets.DatasetConfig(path, "/out", ("eeg",))
    assert len(datasets.expanded_segment_columns()) == 24


def test_missing_data(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, float("inf"), 3.0)], "id long, a double, b double")
    assert [r["id"] for r in datasets.drop_missing(df).collect()] == [1]
    assert datasets.drop_missing(df, "columns").columns == ["id", "b"]


def test_latex():
    text = waveforms.to_latex([{"m": "a_b", "rmse": 1.0}, {"m": "c", "rmse": 0.5}], ["m", "rmse"], {"rmse": "min"})
    assert r"a\_b" in text and r"\textbf{0.50}" in text and waveforms.short_number(0.001234) == "1.23e-03"


def test_ragged(spark):
    df = spark.createDataFrame([(0, 1, 5), (1, 0, None)], "i int, a int, b int")
    assert {r["name"]: r["vector"] for r in waveforms.ragged_vectors(df, "i").collect()} == {"a": [1, 0], "b": [5]}
    assert np.frombuffer(waveforms.sigmf_bytes([1.0], 1.0)[0], "<f4").tolist() == [1.0]


#: A folder of a study's experiments, input_<dataset>/exp<n>.json with their segmenters, splits and metadata.
SHIPPED = os.environ.get("STUDY_CONFIGS", "")


@pytest.mark.skipif(not os.path.isdir(SHIPPED), reason="no folder of configurations is named")
def test_configurations_of_a_study(spark):
    """Every experiment of the folder loads without an unknown key, and names a segmenter and lists that exist."""
    import warnings

    found = 0
    for folder in sorted(os.listdir(SHIPPED)):
        for name in sorted(os.listdir(f"{SHIPPED}/{folder}")):
            if name.startswith("exp"):
                with warnings.catch_warnings():
                    warnings.simplefilter("error")
                    cfg = datasets.DatasetConfig.load(f"{SHIPPED}/{folder}/{name}")
                cfg.values["SIMULATIONS_INPUT_PATH"] = f"{SHIPPED}/{folder}"
                assert cfg.index_path.endswith("_dataset.csv") and "\\" not in cfg.index_path
                assert os.path.isfile(cfg.segmenter_path()) and os.path.isfile(cfg.split_path("train")) and cfg.features_path("train").endswith("_train")
                found += 1
    assert found > 50
    assert "participant_id" in cfg.column_list(spark, "metadata") and "quality_indicator" in cfg.column_list(spark, "segments")


def test_every_known_key_is_silent(tmp_path):
    import json
    import warnings

    values = {k: "x" for k in datasets.KNOWN_KEYS} | {"DATASET_FILE": "..\\data\\made_dataset.csv", "MODALITIES": "ppg,ecg", "SIMULATIONS_INPUT_PATH": "..\\in", "FEATURES_FILE_PREFIX": "features5", "TRAIN_TEST_SPLIT_PREFIX": "made", "SEGMENTER_FILE": "s.json"}
    (tmp_path / "exp5.json").write_text(json.dumps(values))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        cfg = datasets.DatasetConfig.load(str(tmp_path / "exp5.json"))
    assert cfg.index_path == "../data/made_dataset.csv" and cfg.raw_path == "../data/raw" and cfg.segmenter_path() == "../in/segmenters/s.json" and cfg.split_path("test") == "../in/train_test_splits/made_participants_test.txt"
