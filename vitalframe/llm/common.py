"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of one Arrow batch sent to a Python worker, so that long texts cannot fill its memory.
BATCH_BYTES = 8 << 20
#: Fixed value: the seed of the shingles' hash.
SEED = 42


def documents_of(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns of the input with other operators' names cannot clash."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the bytes of Arrow batches for this session, unless the session already bounds them lower."""
    conf = df.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets one of its own; on a cluster
    that is an error, since executors could not read each other's files."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="vitalframe-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once as Parquet to the shared folder and read them back."""
    return written(df, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")


class Tables:
    """Written tables of one computation, removed together once its result is written, with the shuffle files behind them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> DataFrame:
        self.count += 1
        made = written(df, f"{self.folder}/{self.count}")
        release_shuffles(self.spark)
        return made

    def clear(self) -> None:
        remove_folder(self.spark, self.folder)

    def result(self, df: DataFrame) -> DataFrame:
        """The rows as a table that stays, after which the others are removed."""
        made = checkpointed(df)
        self.clear()
        release_shuffles(self.spark)
        return made


def release_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage. Spark deletes a finished query's shuffle files when the driver drops its plan, which
    an idle driver may not do for long; a computation of many written steps would keep the files of all of them."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text):
    """Lower-case A-Z only, as a column expression."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: ASCII letters as small ones, digits and every byte beyond ASCII as they are, all other bytes as blanks.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def plain_words(text: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text, with A-Z lower-cased; a null has none."""
    return (text or b"").translate(_PLAIN).split()


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that releases memory when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped
