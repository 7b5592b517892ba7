"""Benchmark decontamination by winnowing.

A window is `window` consecutive words of a benchmark item, or all words of a shorter item. Of each window of texts and
items alike the gram of about half its words with the smallest hash is kept as its fingerprint, so equal windows keep
equal grams: every shared span of a window's length is met under a common fingerprint. The windows that keep one
which the benchmark may have leave the scan; they are joined with the benchmark's windows on the fingerprint and
extended to the whole window by its words, so a hit is exact. Overlapping hits merge to spans.

What the benchmark may have is a bitmap of FILTER_BITS bits, of one size whatever the benchmark, built as an aggregate;
it only keeps rows out of the shuffle and never decides. Texts of equal words are judged once. Items are listed once for
each distinct set of windows that occurs in a text, so a passage in very many texts does not meet its items again and
again.

Columns of find_contamination: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

Defined cases: a null text has no words and hits nothing; an item without words has no window; a window that several
items have counts for each of them; rows with one item_id are one item, with the windows of all; an item with a null id
marks words but is neither counted nor listed; repeated documents are judged each; empty tables of documents or items
give an empty result and clean documents; any further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import SEED, checkpointed, pick, plain_words, small_batches, tidy

WINDOW = 10
#: Bits of the benchmark's bitmap of fingerprints, 2 MiB.
FILTER_BITS = 1 << 24
#: Odd multiplier of the grams' polynomial, and distinct words whose hashes a task remembers.
BASE, REMEMBERED = 0x9E3779B97F4A7C15, 1 << 19
WINDOWS = "array<struct<start:int,size:int,print:long,words:binary>>"


def gram_size(window: int) -> int:
    """Words of a fingerprint's gram: with it, windows of grams and of words begin at the same places."""
    return (window + 1) // 2


class WordHashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def fingerprints(hashes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows within a text and the fingerprint of each; ends has the end of its text for every word."""
    k, n = gram_size(window), len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.full(len(hashes) - k + 1, window, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(BASE) + hashes[j : j + len(grams)]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    least = grams[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, grams[j : j + n], out=least)
    starts = np.flatnonzero(np.arange(n) + window <= ends[:n])
    return starts, least[starts]


def _flat(texts: list[list[bytes]], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, the end of its text for each word, and where each text begins."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    return hashes, np.repeat(ends, counts), ends - counts


def benchmark_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, size, print, words): every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            row, sizes, prints, contents = [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                words = plain_words(t)
                if not words:
                    continue
                size = min(window, len(words))
                hashes, ends, _ = _flat([words], known)
                starts, found = fingerprints(hashes, ends, size)
                row += [r] * len(starts)
                sizes += [size] * len(starts)
                prints.append(found.view(np.int64))
                contents += [b" ".join(words[s : s + size]) for s in starts.tolist()]
            every = np.concatenate(prints) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(sizes, pa.int32()), pa.array(every), pa.array(contents, pa.binary())], ["item", "size", "print", "words"])

    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(tidy(run), "item string, size int, print long, words binary")


def _bit(value: Column) -> Column:
    return F.pmod(value, F.lit(FILTER_BITS))


def fingerprint_filter(windows: DataFrame) -> np.ndarray:
    """The bitmap of the windows' fingerprints: at most FILTER_BITS / 64 rows reach the driver."""
    one = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    lanes = windows.select(_bit(F.col("print")).alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("lane")).agg(F.bit_or(one).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    found = lanes.toPandas()
    bits[found["lane"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.astype("<i8").view(np.uint8)


def proposed_windows(docs: DataFrame, doc_id: str, text: str, sizes: list[int], filter_bits: np.ndarray) -> DataFrame:
    """(doc_id, key, n_words, windows) for each row: its windows of the given sizes whose fingerprint the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            texts = [plain_words(t) for t in b.column(1).to_pylist()]
            hashes, ends, begins = _flat(texts, known)
            own: list[list[dict]] = [[] for _ in texts]
            for size in sizes:
                starts, prints = fingerprints(hashes, ends, size)
                bit = prints & np.uint64(FILTER_BITS - 1)
                near = np.flatnonzero((filter_bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                text_of = np.searchsorted(begins, starts[near], "right") - 1  # of texts that begin at one place the last one has words
                for r, s, found in zip(text_of.tolist(), starts[near].tolist(), prints[near].view(np.int64).tolist()):
                    at = s - int(begins[r])
                    own[r].append({"start": at, "size": size, "print": found, "words": b" ".join(texts[r][at : at + size])})
            keys = [xxhash.xxh3_128_digest(b" ".join(t)) if w else None for t, w in zip(texts, own)]
            windows = pa.array(own, pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("print", pa.int64()), ("words", pa.binary())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(list(map(len, texts)), pa.int64()), windows], ["doc_id", "key", "n_words", "windows"])

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, n_words long, windows {WINDOWS}")


def _covered(spans: Column) -> Column:
    """Words covered by the (start, end) of an array: spans sorted by start, each counts what lies beyond those before it."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def grow(s: Column, x: Column) -> Column:
        return F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to"))

    return F.aggregate(F.array_sort(spans), start, grow)["n"].cast("long")


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row the words hit by windows of the benchmark, and the items that they belong to."""
    windows = checkpointed(benchmark_windows(items, item_id, item_text, window))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` rows
    scanned = checkpointed(proposed_windows(docs, doc_id, text, sizes, fingerprint_filter(windows)))

    marked = scanned.where("key IS NOT NULL")
    proposed = marked.dropDuplicates(["key"]).select("key", F.inline("windows"))
    known = windows.select("print", "words").distinct()
    hits = proposed.join(known, ["print", "words"])  # the fingerprint, extended to the whole window
    spans = F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end")))
    judged = hits.groupBy("key").agg(_covered(spans).alias("n_hit"), F.array_sort(F.collect_set(F.unhex(F.md5("words")))).alias("set"))
    judged = checkpointed(judged)

    owners = windows.where("item IS NOT NULL").select(F.unhex(F.md5("words")).alias("one"), "item").distinct()
    each = judged.select("set").distinct().select("set", F.explode("set").alias("one"))
    listed = each.join(owners, "one").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    result = judged.join(listed, "set", "left").select("key", "n_hit", "n_items", "items_sha256")

    def row(n_hit: Column, n_items: Column, sha: Column) -> list[Column]:
        hit = F.coalesce(n_hit, F.lit(0).cast("long"))
        return [F.col("doc_id"), F.col("n_words"), hit.alias("n_hit"), F.coalesce(n_items, F.lit(0).cast("long")).alias("n_items"), F.coalesce(sha, F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated")]

    none = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string")
    clean = scanned.where("key IS NULL").select(*row(*none))
    return clean.unionByName(marked.drop("windows").join(result, "key", "left").select(*row(F.col("n_hit"), F.col("n_items"), F.col("items_sha256"))))
