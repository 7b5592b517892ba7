"""Dataset configuration, dataset index, and path expressions."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalframe.functions.nulls import col_of

MODALITIES = ("ppg", "ecg", "bioimp")
MANDATORY = ("participant_id", "session_id", "datetime", "GLC")
SEGMENT_COLUMNS = ("segment_id", "file_id", "modality", "start_sample", "duration", "quality_indicator")
INDEX_DOUBLES = ("GLC", "BP_SYS", "BP_DIA", "BP_HR")
WAVEFORM = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("waveform_id", T.StringType()), T.StructField("fs", T.DoubleType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])
#: The keys of an experiment's configuration.
KNOWN_KEYS = {
    "DATASET_NAME", "DATASET_FILE", "SIMULATIONS_INPUT_PATH", "SIMULATIONS_OUTPUT_PATH", "MODALITIES", "PPG_FS", "ECG_FS", "BIOIMP_FS", "SEGMENTER_FILE", "TRAIN_TEST_SPLIT_PREFIX", "FEATURES_FILE_PREFIX", "FINAL_NUMBER_OF_FEATURES",
    "DROP_TRAINING_EXAMPLES_FOR_PARTICIPANT_BALANCE", "AGGREGATE_FEATURES_INTO_SINGLE_VECTOR", "AGGREGATE_FEATURES_PER_GLUCOSE_MEASUREMENT", "AGGREGATE_FEATURES_PER_FILE",
    *[f"{m}_{k}" for m in ("PPG", "ECG", "BIOIMP") for k in ("SIGNAL_PROCESSING_PIPELINE", "SIGNAL_OUTPUT_WAVEFORM", "SQI_PROCESSING_PIPELINE", "SQI_INPUT_WAVEFORM", "SQI_OUTPUT_WAVEFORM", "FEATURE_EXTRACTION_PIPELINE", "FEATURE_INPUT_WAVEFORM")],
}
FOLDERS = ("waveforms", "segments", "events", "features", "ml")


@dataclass
class DatasetConfig:
    """One experiment: where a dataset lies, how it is processed, and where results go. Paths may be in any store that Spark reads."""

    index_path: str
    output_path: str
    modalities: tuple[str, ...] = MODALITIES
    values: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = set(self.modalities) - set(MODALITIES)
        if unknown:
            raise ValueError(f"unknown modalities {sorted(unknown)}")
        if not self.index_path.endswith("_dataset.csv"):
            raise ValueError("the dataset index is named *_dataset.csv")

    @classmethod
    def load(cls, config: dict | str) -> DatasetConfig:
        """From a dict, JSON text, or the path of a JSON file on the driver; backslashes become slashes, unknown keys warn."""
        if isinstance(config, str):
            if config.lstrip().startswith("{"):
                config = json.loads(config)
            else:
                with open(config, encoding="utf-8") as f:
                    config = json.load(f)
        values = {k: v.replace("\\", "/") if isinstance(v, str) else v for k, v in config.items()}
        for k in sorted(set(values) - KNOWN_KEYS):
            warnings.warn(f"configuration key {k} is not used", stacklevel=2)
        names = values.get("MODALITIES") or ",".join(MODALITIES)
        return cls(values["DATASET_FILE"], values["SIMULATIONS_OUTPUT_PATH"], tuple(m.strip() for m in names.split(",")), values)

    def value(self, key: str, default=None):
        """A configured value; a key without value and default is an error."""
        found = self.values.get(key, default)
        if found is None:
            raise KeyError(f"the configuration lacks {key}")
        return found

    @property
    def root_path(self) -> str:
        return str(PurePosixPath(self.index_path).parent)

    @property
    def raw_path(self) -> str:
        return f"{self.root_path}/raw"

    @property
    def input_path(self) -> str:
        return self.value("SIMULATIONS_INPUT_PATH").rstrip("/")

    def folder(self, kind: str) -> str:
        """Output folder: waveforms, segments, events, features or ml."""
        if kind not in FOLDERS:
            raise ValueError(kind)
        return f"{self.output_path.rstrip('/')}/{kind}"

    def features_path(self, part: str = "") -> str:
        """The table of features: of a modality, of a part of the split, or of its selected features (part + '_selected')."""
        return f"{self.folder('features')}/{self.value('FEATURES_FILE_PREFIX')}" + (f"_{part}" if part else "")

    def segmenter_path(self) -> str:
        return f"{self.input_path}/segmenters/{self.value('SEGMENTER_FILE')}"

    def split_path(self, part: str) -> str:
        """The list of the participants of a part: train, test or excluded."""
        return f"{self.input_path}/train_test_splits/{self.value('TRAIN_TEST_SPLIT_PREFIX')}_participants_{part}.txt"

    def column_list(self, spark: SparkSession, kind: str) -> list[str]:
        """Names of the metadata or segments columns, without the file's first line."""
        lines = spark.read.text(f"{self.input_path}/metadata/{kind}_columns.txt", wholetext=True).first()[0].splitlines()
        return [x.strip() for x in lines[1:] if x.strip()]

    def validate(self, spark: SparkSession) -> None:
        """The index and the folder raw beside it must exist."""
        for path in (self.index_path, self.raw_path):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                raise FileNotFoundError(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ids, dates and paths as text and measurements as doubles; file_id and relative_path are required."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    lacking = {"file_id", "relative_path"} - set(rows.columns)
    if lacking:
        raise ValueError(f"the index lacks {sorted(lacking)}")
    return rows.withColumns({c: F.col(c).try_cast("double") for c in INDEX_DOUBLES if c in rows.columns})


def duplicate_ids(index: DataFrame) -> DataFrame:
    return index.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def file_id_of(index: DataFrame, relative_path: str) -> str:
    """The id of one path; raises unless exactly one row has it."""
    found = index.where(F.col("relative_path") == relative_path).select("file_id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} rows for {relative_path}")
    return found[0][0]


def generated_path(relative_path, waveform_id: str, extension: str) -> Column:
    """waveform_id/<folders>/<stem>_<waveform_id>.<extension>."""
    p = F.regexp_replace(col_of(relative_path), r"\\", "/")
    stem = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    folders = F.regexp_extract(p, r"^(?:raw/)?(.*/)?[^/]*$", 1)
    return F.concat(F.lit(f"{waveform_id}/"), folders, stem, F.lit(f"_{waveform_id}.{extension}"))


def with_extension(path, extension: str) -> Column:
    return F.concat(F.regexp_replace(col_of(path), r"\.[^./]*$", ""), F.lit(f".{extension}"))


def with_mandatory(rows: DataFrame) -> DataFrame:
    """session_id 1 and datetime -1 where absent; other mandatory columns must exist."""
    if "session_id" not in rows.columns:
        rows = rows.withColumn("session_id", F.lit("1"))
    if "datetime" not in rows.columns:
        rows = rows.withColumn("datetime", F.lit("-1"))
    lacking = [c for c in MANDATORY if c not in rows.columns]
    if lacking:
        raise ValueError(f"the table lacks {lacking}")
    return rows


def feature_columns(rows: DataFrame, metadata: list[str], segment: list[str] = list(SEGMENT_COLUMNS)) -> list[str]:  # noqa: B006
    """Feature columns are those in neither list."""
    known = {*metadata, *segment}
    return [c for c in rows.columns if c not in known]


def expanded_segment_columns(prefixes: tuple[str, ...] = ("ppg", "ecg", "bio")) -> list[str]:
    return [*SEGMENT_COLUMNS, *[f"{p}_{c}" for p in prefixes for c in SEGMENT_COLUMNS]]


def choose_modalities(rows: DataFrame, prefixes: list[str], keep: tuple[str, ...] = ("GLC", "participant_id")) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c in keep or any(c.startswith(p) for p in prefixes)])


def prefixed_segment_columns(rows: DataFrame, modality: str) -> DataFrame:
    """Segment columns carry their modality's prefix; bioimp is written bio."""
    short = "bio" if modality.startswith("bioimp") else modality
    return rows.withColumnsRenamed({c: f"{short}_{c}" for c in SEGMENT_COLUMNS if c in rows.columns and c != "modality"})


def target_column(rows: DataFrame, wanted: str = "GLC") -> str:
    """The target's column whatever its case."""
    if wanted in rows.columns:
        return wanted
    found = [c for c in rows.columns if c.lower() == wanted.lower()]
    if len(found) != 1:
        raise ValueError(f"no single column {wanted}")
    return found[0]


def drop_missing(rows: DataFrame, by: str = "rows") -> DataFrame:
    """Without rows, or without columns, that hold a missing number; the columns' null counts come from one pass."""
    numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType)]
    floats = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    rows = rows.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in floats})
    if by == "rows":
        return rows.dropna(subset=numeric) if numeric else rows
    bad = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first().asDict() if numeric else {}
    return rows.drop(*[c for c, n in bad.items() if n])


def first_files(index: DataFrame, n: int, order: str = "file_id") -> DataFrame:
    return index.orderBy(order).limit(n)


def numbered_index(index: DataFrame, order: str) -> DataFrame:
    return index.withColumn("file_ord", F.row_number().over(Window.orderBy(order)) - 1)
