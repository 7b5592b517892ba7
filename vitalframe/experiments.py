"""One experiment of a study, from raw waveforms to the errors of its models, as its configuration says.

Every step is a DataFrame that is written as Parquet to the experiment's output folders and read again, so a run can be
followed and resumed by hand, and no step recomputes another one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.kernels import features, registry
from vitalframe.operators import aggregates, joins, models, segments, signals, splits, stats
from vitalframe.sources import datasets, waveforms

MEASUREMENT = ["participant_id", "session_id", "datetime"]
#: Kernels of the registry by the names that configurations use.
SIGNALS = {
    "ppg": {"bandpass": "bandpass", "reverse": "reverse", "inversion": "inversion", "savitzky": "savitzky", "neurokit": "pulse_clean", "lowpass": "lowpass"},
    "ecg": {"neurokit": "ecg_clean"},
}
QUALITIES = {"ppg": {"sqi_custom": "sqi_custom", "sqi_nkcustom": "sqi_custom", "sqi_neurokit": "sqi_template", "sqi_pyppg": "sqi_pulse", "sqi_sumall": "sqi_all"}, "ecg": {"sqi_neurokit": "sqi_ecg"}}
#: Steps that sweeps know by name; a sweep has one of each.
SWEEPS = {"SIGNAL": {"savitzky": "savitzky"}, "SQI": {"sqi_mse": "sqi_mse"}}
#: Names of all feature groups together, besides a list of groups.
EVERY_GROUP = ("all", "single_vector")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _configured(cfg: datasets.DatasetConfig, modality: str, step: str, known: dict[str, str]) -> str:
    name = cfg.value(f"{modality.upper()}_{step}_PROCESSING_PIPELINE")
    if name not in known:
        raise ValueError(f"no {step.lower()} pipeline {name} for {modality}")
    return known[name]


def feature_groups(cfg: datasets.DatasetConfig, modality: str) -> str:
    """What the configuration names for a modality; only PPG has groups to choose from."""
    wanted = cfg.values.get(f"{modality.upper()}_FEATURE_EXTRACTION_PIPELINE", "all")
    known = EVERY_GROUP if modality == "ppg" else EVERY_GROUP[:1]
    if wanted not in known and (modality != "ppg" or not set(wanted.split(",")) <= set(features.GROUPS)):
        raise ValueError(f"no feature pipeline {wanted} for {modality}")
    return wanted


def read_recordings(spark: SparkSession, cfg: datasets.DatasetConfig) -> DataFrame:
    """The index's rows with the samples of their file."""
    index = datasets.read_index(spark, cfg.index_path)
    stem = F.regexp_replace(F.translate("relative_path", "\\", "/"), r"\.[^./]*$", "")
    waves = waveforms.read_sigmf(spark, cfg.raw_path).select(F.regexp_extract("stem", r"/raw/(.*)$", 1).alias("_stem"), "samples")
    return index.withColumn("_stem", F.regexp_replace(stem, "^raw/", "")).join(waves, "_stem").drop("_stem")


def segments_of(quality: DataFrame, fs: float, segmenter: dict, modality: str) -> DataFrame:
    """Segments of each file by the segmenter: the whole wave, runs of good quality, or windows inside such runs."""
    samples = quality.select("file_id", F.posexplode("samples").alias("i", "q")).withColumn("i", F.col("i").cast("long"))
    use_median = segmenter.get("mean_or_median", "median") == "median"
    if segmenter["type"] == "wave":
        return segments.whole_file_segment(samples, use_median)
    threshold = float(segmenter[f"{modality}_sqi_threshold"])
    if segmenter["type"] == "generic":
        return segments.threshold_runs(samples, threshold, fs, float(segmenter["wave_min_duration"]), use_median)
    size, shift = int(segmenter["window_size_seconds"] * fs), int(segmenter["window_shift_seconds"] * fs)
    runs = segments.threshold_runs(samples, threshold, fs, float(segmenter["window_size_seconds"]), use_median)
    return segments.window_quality(segments.sliding_windows(runs, size, shift), samples, use_median)


def wave_features(spark: SparkSession, cfg: datasets.DatasetConfig, recordings: DataFrame, modality: str, segmenter: dict) -> DataFrame:
    """Segments of one waveform modality with their features, metadata and quality."""
    fs = float(cfg.value(f"{modality.upper()}_FS"))
    own = recordings.where(F.col("modality").contains(modality))
    clean = _stored(registry.process(own, "signal", _configured(cfg, modality, "SIGNAL", SIGNALS[modality]), fs), f"{cfg.folder('waveforms')}/{cfg.value(f'{modality.upper()}_SIGNAL_OUTPUT_WAVEFORM')}_{modality}")
    quality = _stored(registry.process(clean, "quality", _configured(cfg, modality, "SQI", QUALITIES[modality]), fs), f"{cfg.folder('waveforms')}/{cfg.value(f'{modality.upper()}_SQI_OUTPUT_WAVEFORM')}_{modality}")
    cut = _stored(segments.numbered(segments_of(quality, fs, segmenter, modality)), f"{cfg.folder('segments')}/{modality}")
    held = waveforms.sliced(cut, clean).select("segment_id", "samples")
    wanted = feature_groups(cfg, modality)
    groups = tuple(features.GROUPS) if wanted in EVERY_GROUP else tuple(wanted.split(","))
    made = registry.ppg_table(held, fs, groups) if modality == "ppg" else registry.ecg_table(held, fs)
    about = own.drop("samples", "modality", "relative_path")
    return made.drop("status").join(cut, "segment_id").join(about, "file_id").withColumn("modality", F.lit(modality))


def sweep_features(spark: SparkSession, cfg: datasets.DatasetConfig) -> DataFrame:
    """Impedance sweeps, one segment each, with their features, metadata and quality."""
    for step, known in SWEEPS.items():
        if f"BIOIMP_{step}_PROCESSING_PIPELINE" in cfg.values:
            _configured(cfg, "bioimp", step, known)
    feature_groups(cfg, "bioimp")
    index = datasets.read_index(spark, cfg.index_path).where(F.col("modality").contains("bioimp"))
    sweeps = waveforms.read_sweeps(spark, cfg.raw_path).withColumn("relative_path", F.regexp_extract("file", r"/raw/(.*)$", 1))
    rows = sweeps.join(index.withColumn("relative_path", F.regexp_replace("relative_path", "^raw/", "")), "relative_path")
    made = signals.sweep_features(rows, "file_id").drop("bioimp_valid", "bioimp_n_points").join(registry.sweep_qualities(rows, "file_id"), "file_id").join(rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("duration")), "file_id")
    return made.withColumn("start_sample", F.lit(0)).withColumn("segment_id", F.concat(F.lit("seg_"), F.col("file_id"))).withColumn("modality", F.lit("bioimp")).join(index.drop("modality", "relative_path"), "file_id")


def features_of(spark: SparkSession, cfg: datasets.DatasetConfig) -> dict[str, DataFrame]:
    """One table of features per modality, averaged per file or measurement where the configuration asks for it."""
    segmenter = json.loads(spark.read.text(cfg.segmenter_path(), wholetext=True).first()[0])
    recordings, out = read_recordings(spark, cfg), {}
    about = [*MEASUREMENT, "GLC"]
    for m in cfg.modalities:
        rows = sweep_features(spark, cfg) if m == "bioimp" else wave_features(spark, cfg, recordings, m, segmenter)
        names = [c for c in rows.columns if c.startswith(("ppg_", "ecg_", "bioimp_"))]
        flag = lambda k: bool(cfg.values.get(k))
        if flag("AGGREGATE_FEATURES_PER_FILE") or flag("AGGREGATE_FEATURES_INTO_SINGLE_VECTOR"):
            rows = aggregates.one_vector_per(rows, ["file_id", *about], [*names, "quality_indicator"], ["segment_id", "start_sample", "duration", "modality"], "start_sample")
        elif flag("AGGREGATE_FEATURES_PER_GLUCOSE_MEASUREMENT"):
            rows = aggregates.one_vector_per(rows, about, [*names, "quality_indicator"], ["file_id", "segment_id", "start_sample", "duration", "modality"], "segment_id")
        keep = [*about, "segment_id", "file_id", "start_sample", "duration", "quality_indicator"]
        out[m] = _stored(rows.select(*keep, *names), cfg.features_path(m))
    return out


def fused_features(tables: dict[str, DataFrame]) -> DataFrame:
    """The modalities' rows of each measurement side by side, the shorter lists repeated; columns carry their modality's name."""
    if len(tables) == 1:
        return next(iter(tables.values()))
    bare = {m: t.withColumnsRenamed({c: c.removeprefix(f"{m}_") for c in t.columns}) for m, t in tables.items()}
    return joins.fused_quality(joins.fuse(bare, [*MEASUREMENT, "GLC"], "segment_id")).drop("repetition")


def split_features(spark: SparkSession, cfg: datasets.DatasetConfig, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the lists of participants; the training participants balanced where configured."""
    rows = splits.formatted_ids(rows)
    lists = {p: splits.formatted_ids(spark.read.csv(cfg.split_path(p), header=True)) for p in ("train", "test")}
    parts = splits.listed_split(rows, lists)
    if splits.overlapping(parts, "participant_id"):
        raise ValueError("a participant is in both lists")
    train = segments.balanced(parts["train"], "participant_id", "quality_indicator", next(c for c in rows.columns if c.endswith("segment_id"))) if cfg.values.get("DROP_TRAINING_EXAMPLES_FOR_PARTICIPANT_BALANCE") else parts["train"]
    return train, parts["test"]


def run_experiment(spark: SparkSession, config: datasets.DatasetConfig | dict | str, families: Iterable[str] | None = None, model_set: str = "low_overfit", folds: int = 5, inner: int = 3) -> dict[str, DataFrame]:
    """All steps of an experiment. Gives the tables fused, train, test (both with the selected features), cross_validation
    (errors per model over grouped folds) and test_errors."""
    cfg = config if isinstance(config, datasets.DatasetConfig) else datasets.DatasetConfig.load(config)
    cfg.validate(spark)
    fused = _stored(fused_features(features_of(spark, cfg)), cfg.features_path())
    names = [c for c in fused.columns if c.startswith(("ppg_", "ecg_", "bioimp_")) and c.split("_", 1)[1] not in datasets.SEGMENT_COLUMNS]
    train, test = split_features(spark, cfg, fused)
    train = _stored(train, cfg.features_path("train"))
    test = _stored(stats.clean_and_impute(test, names, fit_on=train), cfg.features_path("test"))
    train = _stored(stats.clean_and_impute(train, names), cfg.features_path("train_clean"))
    left = [c for c in names if c in train.columns]
    train, test, chosen = stats.selected_features(train, test, "GLC", left, int(cfg.value("FINAL_NUMBER_OF_FEATURES", -1)))
    train, test = _stored(train, cfg.features_path("train_selected")), _stored(test, cfg.features_path("test_selected"))
    families = list(families or models.MODEL_SETS[model_set])
    found = models.nested_cv(train, splits.group_folds(train, "participant_id", folds), "participant_id", "GLC", chosen, families, inner, model_set)
    errors = models.evaluated(train, test, "participant_id", "GLC", chosen, families, inner, model_set)
    per_model = errors.groupBy("model").agg(*aggregates.regression_errors("actual", "predicted"))
    return {
        "fused": fused, "train": train, "test": test,
        "cross_validation": _stored(models.summary(found), f"{cfg.folder('ml')}/{cfg.value('FEATURES_FILE_PREFIX')}_cross_validation"),
        "test_errors": _stored(per_model, f"{cfg.folder('ml')}/{cfg.value('FEATURES_FILE_PREFIX')}_test_errors"),
    }
