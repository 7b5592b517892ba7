"""Named pipelines over waveforms and their Arrow-backed Spark operators.

A waveform table has file_id and samples (array<double>), one row per file. Kernels run inside the scan's tasks as
mapInArrow: no shuffle, and a batch holds as many files as its byte bound allows. A table of few bytes is one scan task
however long its kernels take; deal its rows out first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.kernels import features, filters, pulses, quality

Kernel = Callable[[np.ndarray, float], np.ndarray]

#: Sample-to-sample kernels by (kind, name).
PIPELINES: dict[tuple[str, str], Kernel] = {
    ("signal", "bandpass"): lambda x, fs: filters.bandpass(x, fs),
    ("signal", "reverse"): lambda x, fs: filters.bandpass(x[::-1], fs),
    ("signal", "inversion"): lambda x, fs: filters.bandpass(filters.remove_outliers(-x, fs, None, 15.0)[0], fs),
    ("signal", "savitzky"): lambda x, fs: filters.savgol(filters.bandpass(x, fs)),
    ("signal", "pulse_clean"): lambda x, fs: filters.bandpass(x, fs, 0.5, 8.0, 3),
    ("signal", "lowpass"): lambda x, fs: (lambda y: y - y.mean())(filters.lowpass(filters.remove_outliers(x, fs, 2000.0, 10.0)[0], fs)),
    ("signal", "ecg_clean"): lambda x, fs: filters.highpass(filters.remove_outliers(x, fs, 200.0, 8.0)[0], fs),
    ("signal", "outliers"): lambda x, fs: filters.remove_outliers(x, fs)[0],
    ("signal", "resample_fourier"): lambda x, fs: filters.resample_fourier(x, fs, 500.0),
    ("signal", "resample_cubic"): lambda x, fs: filters.resample_cubic(x, fs, 500.0),
    ("signal", "inverted_500hz"): lambda x, fs: -filters.resample_fourier(x, fs, 500.0),
    ("signal", "first_mode"): lambda x, fs: features.sift(x, 1)[0],
    ("signal", "savgol"): lambda x, fs: filters.savgol(x),
    ("signal", "prepared"): lambda x, fs: pulses.prepared(x, fs),
    ("signal", "level"): lambda x, fs: pulses.without_baseline(pulses.prepared(x, fs), fs)[0],
    ("signal", "cropped"): lambda x, fs: pulses.cropped(pulses.without_baseline(pulses.prepared(x, fs), fs)[0], fs),
    ("quality", "sqi_custom"): lambda x, fs: quality.custom_quality(x, fs),
    ("quality", "sqi_template"): lambda x, fs: quality.template_quality(x, fs),
    ("quality", "sqi_pulse"): lambda x, fs: quality.pulse_quality(x, fs),
    ("quality", "sqi_all"): lambda x, fs: quality.ensemble(x, fs),
    ("quality", "sqi_ecg"): lambda x, fs: quality.ecg_quality(x, fs),
}


#: Samples that a task holds before it sends the files on.
HELD = 1 << 19


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in turn to four tasks for each core."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """The arrays as one column of lists, without a Python object for each number."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def register_kernel(kind: str, name: str, fn: Kernel) -> None:
    """Add a pipeline of one's own."""
    PIPELINES[kind, name] = fn


def process(waveforms: DataFrame, kind: str, name: str, fs: float) -> DataFrame:
    """file_id, samples, status: the kernel over every file; a file that fails keeps an empty array and its error."""
    fn = PIPELINES[kind, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, waves, out, status, held, start = b.column(0), b.column(1), [], [], 0, 0
            for at in range(len(b)):
                try:
                    out.append(np.asarray(fn(np.array(waves[at].as_py() or [], float), fs), float))
                    status.append("ok")
                except (ValueError, IndexError, FloatingPointError) as e:
                    out.append(np.zeros(0))
                    status.append(f"{type(e).__name__}: {e}")
                held += len(out[-1])
                if held >= HELD or at == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(out)), _lists(out), pa.array(status, pa.string())], ["file_id", "samples", "status"])
                    out, status, held, start = [], [], 0, at + 1

    rows = waveforms.select("file_id", "samples")
    return rows.mapInArrow(run, f"file_id {rows.schema['file_id'].dataType.simpleString()}, samples array<double>, status string")


def extract(segments: DataFrame, fs: float, fn: Callable[[np.ndarray, float], dict[str, float]], names: list[str], key: str = "segment_id") -> DataFrame:
    """One row of named doubles per segment (key, samples); a segment that fails has NULLs and its error in status."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in names]
            status = []
            for x in b.column(1):
                try:
                    found = fn(np.array(x.as_py() or [], float), fs)
                    status.append("ok")
                except (ValueError, IndexError, FloatingPointError) as e:
                    found = {}
                    status.append(f"{type(e).__name__}: {e}")
                for c, n in zip(columns, names):
                    v = found.get(n)
                    c.append(v if v is not None and np.isfinite(v) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.float64()) for c in columns], pa.array(status, pa.string())], [key, *names, "status"])

    rows = segments.select(key, "samples")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"`{n}` double" for n in names) + ", status string")


def ppg_table(segments: DataFrame, fs: float, groups: tuple[str, ...] = tuple(features.GROUPS), key: str = "segment_id") -> DataFrame:
    return extract(segments, fs, lambda x, r: features.ppg_features(x, r, groups), features.ppg_names(groups), key)


def ecg_table(segments: DataFrame, fs: float, key: str = "segment_id") -> DataFrame:
    """One row per segment; every name carries the prefix ecg_."""
    made = extract(segments, fs, features.ecg_features, list(features.ECG), key)
    return made.withColumnsRenamed({n: f"ecg_{n}" for n in features.ECG})


def sweep_waves(rows: DataFrame, key: str, order: str = "i") -> DataFrame:
    """(key, f, magnitude, phase): the sweeps as arrays in the order of measurement; a sweep is some hundred points."""
    made = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "f", "zmag", "zphi"))).alias("_p"))
    return made.select(key, *[F.col(f"_p.{n}").cast("array<double>").alias(a) for n, a in (("f", "f"), ("zmag", "magnitude"), ("zphi", "phase"))])


def smoothed_sweeps(waves: DataFrame, key: str) -> DataFrame:
    """(key, f, mag_filtered, phase_filtered, quality_indicator): smoothed magnitude, smoothed unwrapped phase in degrees, and
    the closeness of the smoothed magnitude to its own smoothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mags = [filters.savgol(np.array(x.as_py(), float)) for x in b.column(2)]
            phases = [filters.savgol(np.rad2deg(np.unwrap(np.deg2rad(np.array(x.as_py(), float))))) for x in b.column(3)]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.tolist() for m in mags], kind), pa.array([p.tolist() for p in phases], kind), pa.array([quality.sweep_quality(m) for m in mags], pa.float64())], [key, "f", "mag_filtered", "phase_filtered", "quality_indicator"])

    rows = waves.select(key, "f", "magnitude", "phase")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, f array<double>, mag_filtered array<double>, phase_filtered array<double>, quality_indicator double")


def sweep_qualities(rows: DataFrame, key: str) -> DataFrame:
    return smoothed_sweeps(sweep_waves(rows, key), key).select(key, "quality_indicator")


def lag_errors(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, error): the lag-aligned squared error of two array columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            found = [quality.lag_error(np.array(x or [], float), np.array(y or [], float)) for x, y in zip(p.column(1).to_pylist(), p.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(found, pa.float64())], [key, "error"])

    rows = pairs.select(key, a, b)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, error double")


def fiducial_table(segments: DataFrame, fs: float, key: str = "file_id") -> DataFrame:
    """One row per pulse (key, pulse) with the sample numbers of its points; a point that a pulse lacks is NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pulse, found = [], [], []
            for r, x in enumerate(b.column(1)):
                points = features.fiducial_points(np.array(x.as_py() or [0.0] * 9, float), fs)
                row += [r] * len(points)
                pulse += range(len(points))
                found += points
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(pulse, pa.int32()), *[pa.array([p[n] for p in found], pa.int64()) for n in features.FIDUCIALS]], [key, "pulse", *features.FIDUCIALS])

    rows = segments.select(key, "samples")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, pulse int, " + ", ".join(f"`{n}` long" for n in features.FIDUCIALS))
