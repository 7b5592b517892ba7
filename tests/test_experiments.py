"""A whole experiment on a small made-up study."""

import json

import numpy as np
import pytest

from vitalframe import experiments
from vitalframe.sources import waveforms

FS = 60


def wave(rng, rate, seconds=30):
    t = np.arange(seconds * FS) / FS
    phase = (t * rate) % 1
    return np.exp(-(((phase - 0.25) / 0.09) ** 2)) + 0.4 * np.exp(-(((phase - 0.6) / 0.11) ** 2)) + 0.02 * rng.normal(size=len(t))


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    """Nine participants with a pulse wave and an electrocardiogram each; the target follows the pulse rate."""
    root, rng = tmp_path_factory.mktemp("study"), np.random.default_rng(0)
    rows = ["participant_id,datetime,session_id,GLC,file_id,relative_path,modality"]
    for k in range(9):
        rate = 1.0 + 0.06 * k
        for m in ("ppg", "ecg"):
            name = f"p_{k:02d}/S1/{m}/{m}_{k}"
            (root / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
            data, meta = waveforms.sigmf_bytes(-wave(rng, rate) if m == "ppg" else wave(rng, rate), FS, file_id=f"{m}{k}")
            (root / "raw" / f"{name}.sigmf-data").write_bytes(data)
            (root / "raw" / f"{name}.sigmf-meta").write_text(meta)
            rows.append(f"p_{k:02d},2025-01-30,S1,{80 + 100 * (rate - 1):.1f},{m}{k},{name}.sigmf-data,{m}")
    (root / "made_dataset.csv").write_text("\n".join(rows) + "\n")
    (root / "in/segmenters").mkdir(parents=True)
    (root / "in/train_test_splits").mkdir()
    (root / "in/segmenters/w.json").write_text(json.dumps({"type": "window", "window_size_seconds": 10, "window_shift_seconds": 10, "mean_or_median": "median", "ppg_sqi_threshold": 0.1, "ecg_sqi_threshold": -1}))
    (root / "in/segmenters/g.json").write_text(json.dumps({"type": "wave", "category": "all"}))
    for part, ids in (("train", range(7)), ("test", (7, 8))):
        (root / f"in/train_test_splits/made_participants_{part}.txt").write_text("participant_id\n" + "\n".join(f"p_{k:02d}" for k in ids) + "\n")
    return root


def config(root, **more):
    return {
        "DATASET_NAME": "made", "DATASET_FILE": str(root / "made_dataset.csv"), "SIMULATIONS_INPUT_PATH": str(root / "in"), "SIMULATIONS_OUTPUT_PATH": str(root / more.pop("out", "out")), "SEGMENTER_FILE": "w.json", "PPG_FS": FS, "ECG_FS": FS,
        "PPG_SIGNAL_PROCESSING_PIPELINE": "inversion", "PPG_SIGNAL_OUTPUT_WAVEFORM": "ppg_inversion", "PPG_SQI_PROCESSING_PIPELINE": "sqi_sumall", "PPG_SQI_OUTPUT_WAVEFORM": "sqi_sumall", "PPG_FEATURE_EXTRACTION_PIPELINE": "p1,s3",
        "ECG_SIGNAL_PROCESSING_PIPELINE": "neurokit", "ECG_SIGNAL_OUTPUT_WAVEFORM": "ecg_neurokit", "ECG_SQI_PROCESSING_PIPELINE": "sqi_neurokit", "ECG_SQI_OUTPUT_WAVEFORM": "sqi_neurokit",
        "TRAIN_TEST_SPLIT_PREFIX": "made", "MODALITIES": "ppg,ecg", "FINAL_NUMBER_OF_FEATURES": 4, "DROP_TRAINING_EXAMPLES_FOR_PARTICIPANT_BALANCE": True, "FEATURES_FILE_PREFIX": "features1", **more}


def test_experiment(spark, study):
    out = experiments.run_experiment(spark, config(study), ["dummy", "lasso", "knn"], folds=3)
    assert out["fused"].count() == 27 and any(c.startswith("ecg_s2_") for c in out["fused"].columns)
    train, test = out["train"], out["test"]
    assert len([c for c in train.columns if c.startswith(("ppg_", "ecg_")) and c.split("_", 1)[1] not in experiments.datasets.SEGMENT_COLUMNS]) == 4
    assert {r[0] for r in train.select("participant_id").distinct().collect()} == {f"p_{k:02d}" for k in range(7)} and {r[0] for r in test.select("participant_id").distinct().collect()} == {"p_07", "p_08"}
    sizes = [r["count"] for r in train.groupBy("participant_id").count().collect()]
    assert len(set(sizes)) == 1
    cv = {r["model"]: r["rmse_mean"] for r in out["cross_validation"].collect()}
    assert set(cv) == {"dummy", "lasso", "knn"} and cv["lasso"] < 0.7 * cv["dummy"]
    errors = {r["model"]: r["rmse"] for r in out["test_errors"].collect()}
    assert errors["lasso"] < errors["dummy"]


def test_unknown_pipeline_is_an_error(spark, study):
    with pytest.raises(ValueError):
        experiments.run_experiment(spark, config(study, out="out3", PPG_SIGNAL_PROCESSING_PIPELINE="magic"), ["dummy"])


def test_names_of_the_registries(study):
    cfg = lambda **more: experiments.datasets.DatasetConfig.load(config(study, **more))
    for modality, step, known in (("ppg", "SIGNAL", experiments.SIGNALS["ppg"]), ("ecg", "SIGNAL", experiments.SIGNALS["ecg"]), ("ppg", "SQI", experiments.QUALITIES["ppg"]), ("bioimp", "SIGNAL", experiments.SWEEPS["SIGNAL"]), ("bioimp", "SQI", experiments.SWEEPS["SQI"])):
        for name in known:
            key = f"{modality.upper()}_{step}_PROCESSING_PIPELINE"
            assert experiments._configured(cfg(**{key: name}), modality, step, known) == known[name]
    for name in ("sqi_sumall", "sqi_pyppg", "sqi_nkcustom", "sqi_neurokit"):
        assert name in experiments.QUALITIES["ppg"]
    for modality, name in (("ppg", "all"), ("ppg", "single_vector"), ("ppg", "p1,s3"), ("ecg", "all"), ("bioimp", "all")):
        assert experiments.feature_groups(cfg(**{f"{modality.upper()}_FEATURE_EXTRACTION_PIPELINE": name}), modality) == name
    for modality, name in (("ppg", "p1,zz"), ("ecg", "single_vector"), ("bioimp", "p1")):
        with pytest.raises(ValueError):
            experiments.feature_groups(cfg(**{f"{modality.upper()}_FEATURE_EXTRACTION_PIPELINE": name}), modality)


def test_fixed_split(spark):
    from vitalframe.operators import splits

    rows = spark.createDataFrame([(f"ieb_0{k}",) for k in range(1, 10)], "participant_id string")
    parts = splits.fixed_split(rows)
    assert {n: t.count() for n, t in parts.items()} == {"train": 6, "validation": 2, "test": 2} and splits.overlapping(parts, "participant_id") == [("validation", "test")]
