"""Importance resampling towards a target distribution, over hashed runs of words.

Features are all runs of 1 to `longest` consecutive words, joined by one space. A streaming CRC ring gives their
buckets: one scan of a document keeps the running checksum of the runs that the last `longest` words began, extends
each by a space and the next word, and emits a bucket every time, so no run is ever put together. The buckets leave that
scan as a table, two bytes each; counts of buckets over the corpus and the target, and the weights, are read from there.

A bucket's gain compares the target's share of features with the corpus's, in thousandths of a natural logarithm. A
document's score is its mean gain plus Gumbel noise from a hash of its id, so the largest scores are a sample without
replacement in proportion to the importance weights. Scores are whole numbers of a bounded range: their histogram, whose
size does not follow the table, gives the lowest score drawn and the number of rows above each score, so only the rows
of one score are ever ordered together, and only drawn ones.

Columns of resample_documents: doc_id, n_features, weight, score, rank.

Defined cases: a null text has no words, no features and weight 0; a null id is hashed as 'null' and comes last among
equal scores; rows that repeat id and text are ranked each, in any order; without a target all counts of it are 0; an
empty table gives an empty result; any further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.llm.common import checkpointed, pick, plain_words, small_batches, tidy

#: Single words, and pairs of running checksum and word, whose next checksum a task remembers.
REMEMBERED = 1 << 19
#: Most buckets, so that a bucket takes two bytes.
MOST_BUCKETS = 1 << 16


class WordChecksums(dict):
    """Checksums of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = crc32(word)
        return found


def ring_buckets(words: list[bytes], longest: int, buckets: int, known: WordChecksums) -> np.ndarray:
    """The bucket of every run of 1 to `longest` words, by its last word and from the longest run to the shortest."""
    if longest == 1:
        return (np.fromiter(map(known.__getitem__, words), np.uint32, len(words)) % buckets).astype("<u2")
    ring: list[int] = []
    found: list[int] = []
    for word in words:
        spaced = b" " + word
        ring = [crc32(spaced, state) for state in ring[-(longest - 1) :]]
        ring.append(known[word])
        found += ring
    return (np.array(found, np.uint32) % buckets).astype("<u2")


def hashed_features(rows: DataFrame, keep: list[str], longest: int, buckets: int) -> DataFrame:
    """The columns to keep, n_words, and the packed buckets of the features of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordChecksums()
        for b in batches:
            texts = [plain_words(t) for t in b.column(len(keep)).to_pylist()]
            made = [ring_buckets(words, longest, buckets, known).tobytes() for words in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(list(map(len, texts)), pa.int64()), pa.array(made, pa.binary())], [*keep, "n_words", "buckets"])

    rows = rows.select(*keep, F.col("text").cast("binary"))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return small_batches(rows).mapInArrow(tidy(run), f"{kinds}n_words long, buckets binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; a task sends each bucket once, and at most `buckets` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for packed in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(packed, "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = small_batches(features.select("buckets")).mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    all_s, all_t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(((t + 1) * all_s) / ((s + 1) * all_t))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, weights = [], []
            for packed in b.column(2).to_pylist():
                own = np.frombuffer(packed, "<u2")
                counts.append(len(own))
                weights.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return small_batches(features.select("doc_id", "n_words", "buckets")).mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def drawn_ranks(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds rank: the place of a row among the highest scores, of so many rows of a hundred of those with least_words or more; else null."""
    may = F.col("n_words") >= least_words
    tall = sorted(((r["score"], r["n"]) for r in rows.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # bounded by the scores' range
    wanted = percent * sum(n for _, n in tall) // 100
    before, above = 0, []
    for score, n in tall:
        if before >= wanted:
            break
        above.append((score, before))
        before += n
    none = F.lit(None).cast("long").alias("rank")
    if not above:
        return rows.withColumn("rank", none)
    starts = rows.sparkSession.createDataFrame(above, "score long, above long")
    chosen = may & (F.col("score") >= above[-1][0])
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())) + F.col("above")
    ranked = rows.where(chosen).join(F.broadcast(starts), "score").withColumn("rank", F.when(place <= wanted, place).cast("long"))
    return rows.where(~chosen).withColumn("rank", none).unionByName(ranked.drop("above"))


def resample_documents(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """Every row with its weight and score, and its rank if it is drawn."""
    if not 1 <= buckets <= MOST_BUCKETS or longest < 1:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}, and runs have a word at least")
    features = checkpointed(hashed_features(pick(docs, doc_id, text).toDF("doc_id", "text"), ["doc_id"], longest, buckets))
    goal = hashed_features(pick(target, target_text).toDF("text"), [], longest, buckets)
    rows = weighted(features, gains(bucket_counts(features, buckets), bucket_counts(goal, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    rows = checkpointed(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))))
    return drawn_ranks(rows, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
