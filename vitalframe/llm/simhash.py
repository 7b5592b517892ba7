"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint's 64 bits form three segments of at most 23 bits. If two fingerprints differ in at most two bits, one
segment is equal in both, and the next segment differs in at most two bits. The perfect binary Golay code [23, 12]
decodes any 23 bits to one codeword within distance 3; the codewords of a segment and its 23 neighbours are one or six
indices, and segments at distance two or less share an index, since some word lies within one bit of both. So
(place of the equal segment, its bits, an index of the next segment) are keys, about 16 for each fingerprint, that
every linked pair shares at least once. Pairs that meet under a key are verified by their true distance.

Equal fingerprints are one node from the start. A key under which more than PAIR_BUCKET fingerprints meet makes no
pairs: its fingerprints are written with each of their 65 variants of at most one flipped bit, and those that share a
variant are linked to the smallest of them, which is exact (a shared variant means a distance of two at most, and any
two fingerprints at that distance share one) and linear. Components come from alternating large-star and small-star
steps on the distributed links; each step writes them to a table that takes the place of the one before.

Columns of near_duplicates: doc_id, fingerprint, component_id.

Defined cases: a null text has no words; a text without words has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; a null doc_id is never a component's id unless all of its ids are null; repeated
rows stay; an empty table gives an empty result; any further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm import jaccard
from vitalframe.llm.common import SEED, Tables, checkpointed, pick, small_batches, tidy
from vitalframe.llm.graph import components

#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Width of each segment, from the fingerprint's lowest bits on.
SEGMENTS = (22, 21, 21)
#: Fingerprints under one key from which on they are linked by shared variants instead of pairs.
PAIR_BUCKET = 32


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Syndrome decoding of 23-bit words to the 12-bit index of their codeword."""

    def __init__(self):
        self.high = np.array([_remainder(i << 11) for i in range(1 << 12)], np.int64)
        self.error = np.zeros(1 << 11, np.int64)
        for weight in range(4):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self.error[_remainder(word)] = word

    def decode(self, words: np.ndarray) -> np.ndarray:
        syndrome = self.high[words >> 11] ^ (words & 0x7FF)
        return (words ^ self.error[syndrome]) >> 11

    def indices(self, words: np.ndarray) -> np.ndarray:
        """(len(words), 24): the index of each word and of its 23 neighbours, sorted."""
        near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
        return np.sort(self.decode(near), axis=1)


def fingerprint_keys(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned 64-bit fingerprints, and the place of the fingerprint that each belongs to."""
    parts, at = [], 0
    for width in SEGMENTS:
        parts.append(((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    keys, owners = [], []
    for i in range(3):
        near = golay.indices(parts[(i + 1) % 3])
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(fresh)
        keys.append(i << 34 | parts[i][row] << 12 | near[row, column])
        owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes, how many have each of the 64 bits. Four bits 16 apart are added at once, in runs below 2^16."""
    sums = np.zeros((len(starts), 64), np.int64)
    ends = np.append(starts[1:], len(hashes))
    if (ends - starts).max(initial=0) >= 1 << 16:
        cuts = [np.arange(s, e, 60_000) for s, e in zip(starts, ends)]
        inner = _bit_sums(hashes, np.concatenate(cuts))
        first = np.cumsum([0, *map(len, cuts[:-1])])
        return np.add.reduceat(inner, first, axis=0)
    mask = np.uint64(0x0001000100010001)
    for k in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & mask, starts)
        for j in range(4):
            sums[:, k + 16 * j] = (lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF)
    return sums


def fingerprints(texts: list[bytes], shingle: int = 3, chunk: int = 1 << 18) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text, given as UTF-8."""
    out = np.zeros(len(texts), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    rows, sizes, hashes, held = [], [], [], 0

    def settle() -> None:
        counts = np.array(sizes)
        starts = np.cumsum(counts) - counts
        sums = _bit_sums(np.concatenate(hashes), starts)
        out[rows] = ((sums * 2 > counts[:, None]) * powers).sum(1, dtype=np.uint64)

    for r, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(words) - shingle + 1)
        first, last = begins[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
        hashes.append(np.array([digest(flat[a:b], SEED) for a, b in zip(first, last)], np.uint64))
        rows.append(r)
        sizes.append(n)
        held += n
        if held >= chunk:
            settle()
            rows, sizes, hashes, held = [], [], [], 0
    if rows:
        settle()
    return out


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long, inside the scan tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = fingerprints([(t or "").encode() for t in b.column(1).to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long")


def fingerprint_links(prints: DataFrame, tables: Tables, most_bits: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints at distance two or less that connect all such fingerprints. They are read
    from one of the tables."""
    if most_bits != 2:
        raise ValueError("the keys are made for a distance of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(own), 20_000):
                part = own[at : at + 20_000]
                keys, owners = fingerprint_keys(part.view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners])], ["key", "print"])

    # Keys are a table of their own: counts combine before their shuffle, and Spark can split a crowded key's join.
    keys = tables.add(prints.select("print").mapInArrow(tidy(run), "key long, print long"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(met, "key")
    few = shared.where(F.col("n") <= pair_bucket)
    a, b = few.select("key", F.col("print").alias("a")), few.select("key", F.col("print").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    variants = shared.where(F.col("n") > pair_bucket).select("print").distinct().select("print", F.explode(F.transform(flips, lambda x: F.col("print").bitwiseXOR(x))).alias("variant"))
    hubs = variants.groupBy("variant").agg(F.min("print").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = variants.join(hubs, "variant").where("hub < print").select(F.col("hub").alias("a"), F.col("print").alias("b"))
    return pairs.unionByName(stars).distinct()


def component_ids(rows: DataFrame, most_bits: int, pair_bucket: int) -> DataFrame:
    """(print, component_id) for each distinct fingerprint of rows (doc_id, print)."""
    prints = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    tables = Tables(rows.sparkSession)
    roots = components(fingerprint_links(prints, tables, most_bits, pair_bucket))
    tables.clear()
    known = prints.join(roots, prints["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(ids, "root").select("print", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, most_bits: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Every row with its fingerprint and the smallest doc_id reachable over links."""
    rows = checkpointed(fingerprint_documents(docs, doc_id, text, shingle))
    found = component_ids(rows, most_bits, pair_bucket)
    return rows.join(found, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _majority(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set of hashes, none of them empty, as a signed number."""
    counts = np.array(list(map(len, sets)))
    sums = _bit_sums(np.concatenate(sets).view(np.uint64), np.cumsum(counts) - counts)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return ((sums * 2 > counts[:, None]) * powers).sum(1, dtype=np.uint64).view(np.int64)


def _candidates(nodes: DataFrame, tables: Tables, pair_bucket: int) -> DataFrame:
    """Pairs (a, b) of sets, given as node and print, that connect those whose fingerprints are equal or linked."""
    least = nodes.groupBy("print").agg(F.min("node").alias("least"))
    equal = nodes.join(least, "print").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(least.select("print"), tables, 2, pair_bucket)
    a, b = least.toDF("a", "x"), least.toDF("b", "y")
    return equal.unionByName(links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """The input's rows, all columns unchanged, without the near copies of a row with a smaller doc_id.

    Near copies have shingle sets of a Jaccard similarity of 4/5 or more, or are linked over such. Fingerprints of the
    sets, met through Golay keys, propose the first pairs; since sets of that similarity mostly differ in more than two
    bits, the exact search of `jaccard` completes them. Every pair is verified by its whole sets.
    """
    tables, small = Tables(docs.sparkSession), Tables(docs.sparkSession)
    signed = tables.add(jaccard.signed_documents(docs, doc_id, text, shingle, _majority))
    rows = checkpointed(signed.select("doc_id", "mark", "node"))
    nodes = small.add(signed.groupBy("node").agg(F.min("print").alias("print")))
    proposed = small.add(_candidates(nodes, small, pair_bucket))
    roots = jaccard.similar_roots(signed, docs, text, shingle, pair_bucket, proposed, tables.clear)
    small.clear()
    return jaccard.without_copies(docs, rows, roots, doc_id, text)
