"""Near-duplicates by the true Jaccard similarity of word shingles, found by an exact prefix filter.

A text is the set of the hashes of its shingles, and equal sets are one node. With the shingles of every set in one
common order, two sets of similarity 4/5 or more share one of the first n // 5 + 1 shingles of each; these are the keys.
Any order finds every pair. The order here puts shingles last that are frequent in a hash sample of the texts, so that a
common passage is rarely a key. The sample changes the cost only, never the result.

Pairs that meet under a key are checked by bitmaps of parities, four bits or more for each shingle, where every differing
bit means a shingle that only one of the sets has, so that no pair of similarity 4/5 is lost. Those left are verified by
their whole sets: first one pair for each set, then those that this has not linked already. A key under which more than
PAIR_BUCKET sets meet is first linked to hubs from its own sets, preferably ones that share the most such keys; after
each round only its sets in different components still matter. Of these, a set's shingles that another set of such keys
has too are counted: a pair cannot share more than the lesser count, so a copy with too many shingles of its own drops
out without being paired. When the pairs that are left are few, or after MOST_ROUNDS, all of them are checked. So
components are those of all pairs of similarity 4/5 or more; the work is linear for groups around common texts, and
grows with the square of a key only for sets that share it, are not linked, and have hardly a shingle of their own.

Defined cases: a null text or one without words is near no other; fewer words than a shingle make one shingle; a null
doc_id is kept only if all of its group are null; rows of equal doc_id and text stay or go together; an empty table
gives an empty result; any further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import SEED, Tables, pick, small_batches, tidy
from vitalframe.llm.graph import components

#: Sets under one key from which on hubs come first.
PAIR_BUCKET = 32
#: Hubs of a crowded key that are drawn in each round, and the most rounds.
HUBS, MOST_ROUNDS = 3, 2
#: Pairs left for each row of the crowded keys up to which all are verified.
PAIRS_A_ROW = 32
#: 64-bit lanes of the bitmaps that crowded keys carry.
LANES = 16
#: One text in so many counts for the order, and the most frequent shingles that it knows.
SAMPLE, MOST_COMMON = 16, 1 << 17


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = begins[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[a:b], SEED) for a, b in zip(first, last)], np.uint64).view(np.int64))


def node_of(found: np.ndarray) -> int:
    """The number of a set: a signed 64-bit hash of its sorted shingles."""
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), SEED), np.uint64).view(np.int64))


def bitmap(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's shingles falls to each bit, as 64-bit lanes; the bits are a power of two, four
    times the shingles at least. Halves folded by XOR are the bitmap of half the bits."""
    bits = max(64, 1 << (4 * len(found) - 1).bit_length())
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def common_shingles(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, sorted, that are frequent in the sample, and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle))], ["key"])

    some = pick(docs, text).toDF("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = small_batches(some).mapInArrow(tidy(run), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = sorted((r["key"], r["n"]) for r in counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def signed_documents(docs: DataFrame, doc_id: str, text: str, shingle: int, prints_of: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """doc_id, mark (a hash of the text), node, size, print (by prints_of, from the sets), bits and keys of each text that has words."""
    known, counts = common_shingles(docs, text, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sets, bits, keys = [], [], [], []
            for r, t in enumerate(b.column(2).to_pylist()):
                found = shingles(t, shingle)
                if not len(found):
                    continue
                often = np.zeros(len(found), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    often = np.where(known[at] == found, counts[at], 0)
                rows.append(r)
                sets.append(found)
                bits.append(bitmap(found))
                keys.append(found[np.lexsort((found, often))[: len(found) // 5 + 1]])
            if rows:
                nodes, sizes = pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32())
                more = [pa.array(prints_of(sets), pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), nodes, sizes, *more], ["doc_id", "mark", "node", "size", "print", "bits", "keys"])

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text").selectExpr("doc_id", "xxhash64(text) AS mark", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, mark long, node long, size int, print long, bits array<long>, keys array<long>")


def _folded(bits, lanes: int):
    """A bitmap folded to at most so many lanes, a power of two."""
    parts = F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / lanes).cast("int"))
    zero = F.array_repeat(F.lit(0).cast("long"), lanes)
    folded = F.aggregate(parts, zero, lambda s, i: F.zip_with(s, F.slice(bits, i * lanes + 1, F.lit(lanes)), lambda p, q: p.bitwiseXOR(q)))
    return F.when(F.size(bits) <= lanes, bits).otherwise(folded)


def _bits_apart(x, y):
    """Differing bits of the bitmaps x and y, one of which may have twice the lanes."""
    small, large = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    half = F.size(small)
    folded = F.when(F.size(large) == half, large).otherwise(F.zip_with(F.slice(large, F.lit(1), half), F.slice(large, half + 1, half), lambda p, q: p.bitwiseXOR(q)))
    return F.aggregate(F.zip_with(small, folded, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _sets_of(marks: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, found): the whole sets of the nodes of marks (node, mark), made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "found"])

    texts = pick(docs, text).toDF("text").withColumn("mark", F.xxhash64("text")).join(marks, "mark").select("node", "text")
    return small_batches(texts).mapInArrow(tidy(run), "node long, found array<long>")


def _shared_counts(marks: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, common): how many of a set's shingles another of the sets has too; a set without any is absent."""
    each = _sets_of(marks, docs, text, shingle).select("node", F.explode("found").alias("one"))
    met = each.groupBy("one").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one")
    return each.join(met, "one").groupBy("node").agg(F.count(F.lit(1)).alias("common"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Of the pairs (a, b) of nodes, a < b, links of a similarity of 4/5 or more that connect all those of this similarity.

    Whole sets are made again from one text of each node, and only for pairs that their bitmaps allow.
    """
    tables = Tables(docs.sparkSession)
    a = nodes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x"))
    b = nodes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y"))
    met = pairs.distinct().join(a, "a").join(b, "b").where(_alike(F.col("m"), F.col("n")))
    left = tables.add(met.where(_bits_apart(F.col("x"), F.col("y")) * 9 <= F.col("m") + F.col("n")).select("a", "b"))
    wanted = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # A table of its own, so that Spark knows its size before it chooses whether texts are shuffled to it.
    marks = tables.add(nodes.join(wanted, "node", "left_semi").select("node", "mark"))
    sets = tables.add(_sets_of(marks, docs, text, shingle))

    def alike(some: DataFrame) -> DataFrame:
        b = sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
        hubs = sets.join(some.select(F.col("a").alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.first("found").alias("x"))
        both = F.size(F.array_intersect("x", "y"))
        found = some.join(b, "b").join(hubs.withColumnRenamed("node", "a"), "a")
        return tables.add(found.where(both * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b").distinct())

    first = alike(tables.add(left.groupBy("b").agg(F.min("a").alias("a"))))
    ours, theirs = first.select(F.col("b").alias("a"), F.col("a").alias("p")), first.select("b", F.col("a").alias("q"))
    # a and b are linked already where b went to a, or both went to one set
    rest = left.join(ours, "a", "left").join(theirs, "b", "left").where((F.coalesce("q", "b") != F.coalesce("p", "a")) & ~F.col("q").eqNullSafe(F.col("a")))
    return tables.result(first.unionByName(alike(tables.add(rest.select("a", "b")))))


def _alike(x, y):
    """Whether sets of these sizes can have a similarity of 4/5."""
    return F.least(x, y) * 5 >= F.greatest(x, y) * 4


def _hub_pairs(crowded: DataFrame, turn: int) -> DataFrame:
    """Pairs of each set under a key with the key's hubs; crowded has key, node, size, weight and root, and pairs within a root are left out."""
    one = F.struct("node", "size", "root")
    draws = [F.min_by(one, F.xxhash64("node", F.lit(turn * HUBS + i))) for i in range(HUBS)]
    if turn == 0:
        draws.append(F.max_by(one, F.struct("weight", "node")))
    hubs = crowded.groupBy("key").agg(F.array_distinct(F.array(*draws)).alias("hubs"))
    met = crowded.join(hubs, "key").select("node", "size", "root", F.explode("hubs").alias("hub"))
    met = met.where((F.col("root") != F.col("hub.root")) & _alike(F.col("size"), F.col("hub.size")))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def _all_pairs(rows: DataFrame, apart) -> DataFrame:
    """All pairs under each key for which apart(x, y) holds."""
    x, y = rows.alias("x"), rows.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & _alike(F.col("x.size"), F.col("y.size")) & apart
    return x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def similar_roots(signed: DataFrame, docs: DataFrame, text: str, shingle: int, pair_bucket: int, proposed: DataFrame, signed_read: Callable[[], None] = lambda: None) -> DataFrame:
    """(node, root) of all nodes that are linked to another one; the pairs proposed are verified beside those found here.
    signed_read is called when signed has been read for the last time."""
    tables, early = Tables(docs.sparkSession), Tables(docs.sparkSession)
    # Of rows with equal sets one stands for all. These are few, so that the others are not shuffled for them.
    again = tables.add(signed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"))
    own = signed.select("node", "mark", "size", "bits", "keys")
    own = own.join(again, "node", "left_anti").unionByName(own.join(again, "node", "left_semi").dropDuplicates(["node"]))
    nodes = tables.add(own.select("node", "mark", "size", "bits"))
    keys = own.select(F.explode("keys").alias("key"), "node", "size")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = early.add(keys.join(met, "key"))
    signed_read()
    crowded = shared.where(F.col("n") > pair_bucket).select("key", "node", "size")
    crowded = tables.add(crowded.join(crowded.groupBy("node").agg(F.count(F.lit(1)).alias("weight")), "node"))
    first = _all_pairs(shared.where(F.col("n") <= pair_bucket), F.lit(True))
    pairs = proposed.unionByName(first).unionByName(_hub_pairs(crowded.withColumn("root", F.col("node")), 0))
    links = verified(pairs, nodes, docs, text, shingle)
    early.clear()
    roots = components(links)
    common = None
    for turn in range(1, MOST_ROUNDS + 1):
        parts = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        parts = parts.withColumn("common", F.col("size")) if common is None else parts.join(common, "node").where("common * 5 >= size * 4")
        counts = parts.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        parts = tables.add(parts.join(counts.select("key", "n", "within"), "key"))
        if common is None and parts.take(1):
            # A table of its own, so that Spark knows its size before it chooses whether texts are shuffled to it.
            marks = tables.add(nodes.join(parts.select("node").distinct(), "node", "left_semi").select("node", "mark"))
            common = tables.add(_shared_counts(marks, docs, text, shingle))
            parts = tables.add(parts.drop("common").join(common, "node").where("common * 5 >= size * 4"))
        left = parts.select("key", "n", "within").distinct().agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)).first()
        if not left[0]:
            break
        last = turn == MOST_ROUNDS or left[1] <= PAIRS_A_ROW * left[0]
        rows = parts.select("key", "node", "size", "weight", "common", "root")
        if last:
            rows = rows.join(nodes.select("node", _folded(F.col("bits"), LANES).alias("bits")), "node")
            enough = F.least("x.common", "y.common") * 9 >= (F.col("x.size") + F.col("y.size")) * 4
            near = _bits_apart(F.col("x.bits"), F.col("y.bits")) * 9 <= F.col("x.size") + F.col("y.size")
            pairs = _all_pairs(rows, (F.col("x.root") != F.col("y.root")) & enough & near)
        else:
            pairs = _hub_pairs(rows, turn)
        links = links.unionByName(verified(pairs, nodes, docs, text, shingle))
        roots = components(links)
        if last:
            break
    return tables.result(roots)


def without_copies(docs: DataFrame, signed: DataFrame, roots: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs but for those that are linked to a row with a smaller doc_id."""
    rows = signed.join(roots, "node", "left").select("doc_id", "mark", F.coalesce("root", "node").alias("root"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = rows.groupBy("root").agg(F.min(own).alias("own"))
    gone = rows.join(first, "root").where(~(F.col("mark").eqNullSafe(F.col("own.mark")) & F.col("doc_id").eqNullSafe(F.col("own.doc_id"))))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    same = F.col(f"`{doc_id}`").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(F.col(f"`{text}`")) == gone["_gone_mark"])
    return docs.join(gone, same, "left_anti")
