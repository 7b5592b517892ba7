"""Waveform and sweep files as DataFrames, read by Spark's own sources, so that any store works."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "global struct<`core:datatype`: string, `core:sample_rate`: double, `myproject:file_id`: string>"


def read_sigmf(spark: SparkSession, path: str) -> DataFrame:
    """path_stem, fs, datatype, samples for each pair of data and metadata files below a folder.

    rf32_le data only. Binary contents are decoded in the scan's tasks; the small metadata joins by path.
    """
    stem = lambda c: F.regexp_replace(c, r"\.sigmf-(?:data|meta)$", "")
    meta = spark.read.schema(META).option("multiLine", True).option("pathGlobFilter", "*.sigmf-meta").option("recursiveFileLookup", True).json(path).select(
        stem(F.input_file_name()).alias("_meta"), F.col("global.`core:sample_rate`").alias("fs"), F.col("global.`core:datatype`").alias("datatype"), F.col("global.`myproject:file_id`").alias("file_id"))
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.sigmf-data").option("recursiveFileLookup", True).load(path).select(stem(F.col("path")).alias("stem"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            samples = [np.frombuffer(c.as_py(), "<f4").astype(float).tolist() for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(samples, pa.list_(pa.float64()))], ["stem", "samples"])

    tail = lambda c: F.regexp_replace(c, r"^[a-z]+:/+", "/")
    waves = data.mapInArrow(decode, "stem string, samples array<double>").withColumn("_at", tail(F.col("stem")))
    joined = waves.join(meta.withColumn("_at", tail(F.col("_meta"))).drop("_meta"), "_at").drop("_at")
    return joined.withColumn("samples", F.when(F.col("datatype") == "rf32_le", F.col("samples")).otherwise(F.raise_error(F.concat(F.lit("unknown datatype "), F.col("datatype"))).cast("array<double>")))


def sigmf_bytes(samples, fs: float, description: str = "", file_id: str = "") -> tuple[bytes, str]:
    """Data and metadata of one file."""
    meta = {"global": {"core:datatype": "rf32_le", "core:sample_rate": fs, "core:version": "1.0.0", "core:description": description, "myproject:file_id": file_id}, "captures": [{"core:sample_start": 0}], "annotations": []}
    return np.asarray(samples, "<f4").tobytes(), json.dumps(meta, indent=2)


def write_waveforms(waveforms: DataFrame, path: str) -> None:
    """The waveform table as Parquet, partitioned by waveform_id and modality."""
    waveforms.write.mode("overwrite").partitionBy("waveform_id", "modality").parquet(path)


def read_waveforms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_signal_csv(spark: SparkSession, path: str, column: str = "mag_filtered") -> DataFrame:
    """file, samples of one column of CSV files, in line order."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    head = F.split(F.col("lines")[0], "[,;]")
    place = F.array_position(F.transform(head, F.trim), column)
    body = F.filter(F.slice("lines", 2, F.size("lines")), lambda x: F.length(F.trim(x)) > 0)
    return text.select("file", F.transform(body, lambda x: F.element_at(F.split(x, "[,;]"), place.cast("int")).try_cast("double")).alias("samples"))


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """Impedance sweeps: file, i, mnum, f, zmag, zphi, zim, zre, satur. Lines before the one that starts with mnum are
    skipped; the delimiter is the header's own."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    start = F.array_position(F.transform("lines", lambda x: x.startswith("mnum")), True).cast("int")
    head = F.element_at("lines", start)
    delimiter = F.when(F.contains(head, F.lit(";")), ";").otherwise(",")
    rows = text.where(start > 0).select("file", delimiter.alias("d"), F.posexplode(F.filter(F.slice("lines", start + 1, F.size("lines")), lambda x: F.length(F.trim(x)) > 0)).alias("i", "line"))
    part = F.split("line", F.col("d"))
    names = ("mnum", "f", "zmag", "zphi", "zim", "zre", "satur")
    kinds = ("int", "double", "double", "double", "double", "double", "int")
    return rows.select("file", "i", *[F.try_element_at(part, F.lit(k + 1)).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds))])


def ragged_vectors(rows: DataFrame, key: str) -> DataFrame:
    """Columns of uneven length as (name, vector), NULLs left out, in the order of the key."""
    names = [c for c in rows.columns if c != key]
    long = rows.unpivot([key], names, "name", "value").where("value IS NOT NULL")
    return long.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "value"))), lambda x: x["value"]).alias("vector"))


def long_samples(waveforms: DataFrame) -> DataFrame:
    """(file_id, i, x) rows of a waveform table."""
    return waveforms.select("file_id", F.posexplode("samples").alias("i", "x"))


def sliced(segments: DataFrame, waveforms: DataFrame) -> DataFrame:
    """Each segment with its own samples, clamped at the file's end; invalid intervals drop out."""
    return segments.where("start_sample >= 0 AND duration > 0").join(waveforms.select("file_id", F.col("samples").alias("_all")), "file_id").withColumn(
        "samples", F.slice("_all", F.col("start_sample").cast("int") + 1, F.col("duration").cast("int"))).drop("_all")


def to_latex(rows: list[dict], columns: list[str], best: dict[str, str] | None = None) -> str:
    """A small table as LaTeX; best names per column whether the 'min' or 'max' is set in bold."""
    best = best or {}
    escape = lambda s: str(s).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&").replace("#", r"\#")
    tops = {c: {"min": min, "max": max}[how](r[c] for r in rows if r[c] is not None) for c, how in best.items() if any(r[c] is not None for r in rows)}

    def cell(r: dict, c: str) -> str:
        v = r[c]
        shown = "--" if v is None else short_number(v) if isinstance(v, float) else escape(v)
        return rf"\textbf{{{shown}}}" if c in tops and v == tops[c] else shown

    body = " \\\\\n".join(" & ".join(cell(r, c) for c in columns) for r in rows)
    return "\\begin{tabular}{" + "l" * len(columns) + "}\n" + " & ".join(escape(c) for c in columns) + " \\\\ \\hline\n" + body + " \\\\\n\\end{tabular}"


def short_number(v: float) -> str:
    """Two decimals, or scientific below a hundredth."""
    return f"{v:.2f}" if v == 0 or abs(v) >= 0.01 else f"{v:.2e}"
