"""Exact dedup with Patricia-trie owners.

Texts are normalised (A-Z to lower case) and inserted as full byte strings into compressed radix tries, one per
partition of (length, content hash); a terminal node keeps the identifier that stays and the number of copies. Each
scan task first runs its own trie, emptied when full but for its repeated texts, so a text copied without end leaves a
task about once; the merged owners are shuffled by length and hash, and each partition is inserted into one trie. A trie
that outgrows its memory spills its heaviest subtrees to the task's temporary folder and finishes them afterwards; a
single text is held whole, however long.

Columns of dedup_documents: doc_id, keep_id, group_size, kept, text_sha256.

Defined cases: a null text counts as the empty text; of equal texts the row with the largest doc_id stays; a null
doc_id never outranks a number, and if all are null keep_id is null; of rows that share both text and doc_id each
gets kept = true for the largest doc_id; an empty table gives an empty result; any further columns are ignored.
"""

from __future__ import annotations

import hashlib
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.llm.common import ascii_lower, pick, small_batches, tidy

#: Bytes of labels that a task's trie may hold before it spills or is emptied.
TRIE_BYTES = 24 << 20
#: Rough cost of a node beside its label.
NODE_BYTES = 200


class _Node:
    __slots__ = ("label", "children", "owner", "count", "file")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count, self.file = label, None, None, 0, None


def _shared(a: bytes, at: int, b: bytes) -> int:
    """How many bytes of a from `at` on equal the start of b, found by halving."""
    most = min(len(a) - at, len(b))
    if a[at : at + most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        mid = (low + high) // 2
        if a[at + low : at + mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaOwners:
    """A compressed radix trie from byte strings to (largest identifier, number of copies).

    Beyond most_bytes the subtrees of the first node where keys really part are moved, the heaviest first, to temporary
    files of the task, until half of the bound is free; further keys of such a subtree go straight to its file. A file
    is finished in a trie of its own, which parts at a deeper place, so a file of one key never spills.
    """

    def __init__(self, most_bytes: int = TRIE_BYTES):
        self.root, self.most, self.used = _Node(b""), most_bytes, 0
        self.stuck = 0  # bytes at which the trie last had nothing to spill
        self.files: list = []

    @staticmethod
    def _merge(node: _Node, owner: int | None, count: int) -> None:
        if owner is not None and (node.owner is None or owner > node.owner):
            node.owner = owner
        node.count += count

    def add(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at, size = self.root, 0, len(key)
        while at < size:
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = _Node(key[at:])
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = child
                self.used += NODE_BYTES + size - at
                node, at = child, size
                break
            if child.file is not None:
                self._write(child.file, key, owner, count)
                return
            common = _shared(key, at, child.label)
            if common < len(child.label):
                upper = _Node(child.label[:common])
                child.label = child.label[common:]
                upper.children = {child.label[0]: child}
                node.children[key[at]] = upper
                self.used += NODE_BYTES
                child = upper
            node, at = child, at + common
        self._merge(node, owner, count)
        if self.used > max(self.most, self.stuck):
            self._spill()

    @staticmethod
    def _write(f, key: bytes, owner: int | None, count: int) -> None:
        f.write(struct.pack("<q?qq", len(key), owner is None, owner or 0, count))
        f.write(key)

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while not node.count and node.children and len(node.children) == 1:
            (below,) = node.children.values()
            if below.file is not None:
                break
            node, prefix = below, prefix + below.label
        weights = {b: _weight(c) for b, c in (node.children or {}).items() if c.file is None}
        if len(node.children or {}) + bool(node.count) > 1:
            for byte, weight in sorted(weights.items(), key=lambda x: -x[1]):
                if self.used <= self.most // 2:
                    break
                branch, gone = node.children[byte], _Node(bytes([byte]))
                gone.file = tempfile.TemporaryFile()
                for key, owner, count in _terminals(branch, prefix):
                    self._write(gone.file, key, owner, count)
                for f in _files(branch):  # a subtree that spilled earlier, before keys parted higher up
                    f.seek(0)
                    shutil.copyfileobj(f, gone.file)
                    self.files.remove(f)
                    f.close()
                node.children[byte] = gone
                self.files.append(gone.file)
                self.used -= weight
        self.stuck = self.used * 2 if self.used > self.most // 2 else 0

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Every key once, with its owner and count; spilled subtrees come last, each through a trie of its own."""
        yield from _terminals(self.root, b"")
        files, self.files, self.root, self.used = self.files, [], _Node(b""), 0
        while files:
            f = files.pop()
            f.seek(0)
            sub = PatriciaOwners(self.most)
            while head := f.read(25):
                size, missing, owner, count = struct.unpack("<q?qq", head)
                sub.add(f.read(size), None if missing else owner, count)
            f.close()
            yield from _terminals(sub.root, b"")
            files += sub.files


def _terminals(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
    """The keys below a node that are held in memory."""
    stack = [(top, prefix)]
    while stack:
        node, before = stack.pop()
        key = before + node.label
        if node.count:
            yield key, node.owner, node.count
        stack += [(c, key) for c in (node.children or {}).values() if c.file is None]


def _files(top: _Node) -> list:
    found, stack = [], [top]
    while stack:
        node = stack.pop()
        found += [node.file] if node.file is not None else []
        stack += (node.children or {}).values()
    return found


def _weight(top: _Node) -> int:
    total, stack = 0, [top]
    while stack:
        node = stack.pop()
        total += NODE_BYTES + len(node.label)
        stack += (node.children or {}).values()
    return total


def _owners(docs: DataFrame, doc_id: str, text: str, trie_bytes: int) -> DataFrame:
    """Per scan task, one row for each distinct normalised text: length, hash, text, owner, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaOwners(trie_bytes)
        for b in batches:
            for owner, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trie.add((text or "").encode().lower(), owner)
            if trie.used > trie_bytes // 2:
                held = _Repeated(trie.items(), trie_bytes // 8)
                yield from _rows(held)
                trie = PatriciaOwners(trie_bytes)
                for key, owner, count in held.kept:
                    trie.add(key, owner, count)
        yield from _rows(trie.items())

    rows = small_batches(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")))
    return rows.mapInArrow(tidy(run), "length long, hash long, body binary, owner long, copies long")


class _Repeated:
    """Passes the entries of a full trie on, but keeps up to most_bytes of repeated ones, which may repeat again later in the task."""

    def __init__(self, items: Iterator[tuple[bytes, int | None, int]], most_bytes: int):
        self.items, self.room, self.kept = items, most_bytes, []

    def __iter__(self) -> Iterator[tuple[bytes, int | None, int]]:
        for key, owner, count in self.items:
            if count > 1 and len(key) + NODE_BYTES <= self.room:
                self.room -= len(key) + NODE_BYTES
                self.kept.append((key, owner, count))
            else:
                yield key, owner, count


def _rows(items: Iterable[tuple[bytes, int | None, int]], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    some, held = [], 0
    for key, owner, count in items:
        some.append((len(key), xxhash.xxh64_intdigest(key) - (1 << 63), key, owner, count))
        held += len(key)
        if held >= size:
            yield _batch(some)
            some, held = [], 0
    if some:
        yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    length, hashed, body, owner, copies = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(length, pa.int64()), pa.array(hashed, pa.int64()), pa.array(body, pa.binary()), pa.array(owner, pa.int64()), pa.array(copies, pa.int64())],
        ["length", "hash", "body", "owner", "copies"],
    )


def _settle(batches: Iterator[pa.RecordBatch], trie_bytes: int) -> Iterator[pa.RecordBatch]:
    """All rows of a partition of (length, hash) in one trie; its terminals are the groups."""
    trie = PatriciaOwners(trie_bytes)
    for b in batches:
        for body, owner, copies in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)]):
            trie.add(body, owner, copies)
    sha, keep, size = [], [], []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(sha, pa.string()), pa.array(keep, pa.int64()), pa.array(size, pa.int64())], ["text_sha256", "keep_id", "group_size"])
        for x in (sha, keep, size):
            x.clear()
        return made

    for key, owner, count in trie.items():
        sha.append(hashlib.sha256(key).hexdigest())
        keep.append(owner)
        size.append(count)
        if len(sha) == 10_000:
            yield batch()
    yield batch()


def text_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, keep_id, group_size."""
    owners = _owners(docs, doc_id, text, trie_bytes)
    parts = owners.repartition("length", "hash")
    return small_batches(parts).mapInArrow(tidy(lambda batches: _settle(batches, trie_bytes)), "text_sha256 string, keep_id long, group_size long")


def dedup_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Every row with its group. Rows meet their group by hash; a hot group makes a skewed join, which Spark splits."""
    groups = text_groups(docs, doc_id, text, trie_bytes)
    rows = pick(docs, doc_id, text).toDF("doc_id", "_text")
    rows = rows.select("doc_id", F.sha2(ascii_lower(F.coalesce("_text", F.lit(""))), 256).alias("text_sha256"))
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The input's rows, all columns unchanged, that own their normalised text: the largest doc_id of each group; of rows that also share it, one."""
    groups = text_groups(docs, doc_id, text, trie_bytes)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{doc_id}`").cast("long").alias("_id"), F.sha2(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), 256).alias("_sha"))
    own = rows.join(groups, (rows["_sha"] == groups["text_sha256"]) & rows["_id"].eqNullSafe(groups["keep_id"]), "left_semi")
    one = own.withColumn("_n", F.row_number().over(Window.partitionBy("_sha").orderBy("_id"))).where("_n = 1")
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
