"""Substring dedup with difference-cover anchors.

A window is WINDOW consecutive words. Hashing every window would shuffle one hash per word. Instead anchors, shorter
windows of WINDOW - PERIOD + 1 words, are hashed only where the position modulo PERIOD lies in a perfect difference
set. For any two places of one window some shift below PERIOD lands on a cover position in both, so the two share an
aligned anchor inside it. Repeated anchors are extended: only windows around them are hashed whole, with 128 bits, and
windows whose hash occurs twice remove the words that they cover.

Texts are first reduced to distinct ones with a count of copies, in the scan tasks before the shuffle; a text that has
copies repeats all of its windows. Hashes are combined within a batch before they are shuffled: of those that repeat
there, one leaves the batch, so a passage in every document costs one entry per batch. Hashes meet in buckets by their
value, packed as arrays; the number of buckets follows the bytes of text, so that one fits a task's memory.

Columns of remove_repeats: doc_id, n_words, n_removed, kept_sha256.

Defined cases: a null or empty text has no words and keeps the hash of the empty string; texts shorter than a window
stay whole; windows are judged on the input; repeated rows count as copies; an empty table gives an empty result; any
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import pick, small_batches

WINDOW = 35
PERIOD = 21
#: Fixed value: a perfect difference set modulo 21; every residue is a difference of two members.
COVER = (0, 1, 4, 14, 16)
#: Base of the polynomial window hash modulo 2^64 (odd) and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Entries that a bucket holds on average at most.
BUCKET_ENTRIES = 1 << 20
#: Least bytes of a word with its blank, on average, from which the number of buckets is taken.
WORD_BYTES = 5
KEY = 16
#: Bytes of text that a task counts copies of at once, and that a task of the passes over texts reads on average.
HELD_BYTES, TASK_BYTES = 8 << 20, 32 << 20

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps)
    return have[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits for each word, as two unsigned numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on, in each lane: the sum of word hash times BASE^place."""
    sums = np.zeros((len(hashes) + 1, hashes.shape[1]), np.uint64)
    np.cumsum(hashes * _powers(BASE, len(hashes))[:, None], axis=0, out=sums[1:])
    return (sums[at + size] - sums[at]) * _powers(INVERSE, len(hashes) + 1)[at][:, None]


def cover_positions(n: int, anchor: int) -> np.ndarray:
    """Positions of anchors in a text of n words."""
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    at = np.arange(max(0, n - anchor + 1))
    return at[member[at % PERIOD]]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mixed(hashes) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """A lone lane keeps 32 mixed bits beside its bucket: it only proposes, and what it wrongly proposes is hashed whole."""
    return _mixed(hashes[:, 0]).astype(np.uint32).tobytes() if hashes.shape[1] == 1 else hashes.tobytes()


def _unpacked(raw: np.ndarray, lanes: int) -> np.ndarray:
    return raw.view(np.uint32).reshape(-1, 1) if lanes == 1 else raw.view(np.uint64).reshape(-1, lanes)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers begins, and its length."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return begins, np.diff(np.append(begins, len(values)))


class Combiner:
    """Combines a batch's entries (hash, text, position) and packs them by bucket."""

    def __init__(self, lanes: int, buckets: int):
        self.lanes, self.buckets = lanes, buckets
        self.clear()

    def clear(self) -> None:
        self.keys: list[bytes] = []
        self.hashes: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.copied: list[bool] = []
        self.held = 0

    def add(self, key: bytes, hashes: np.ndarray, at: np.ndarray, copied: bool) -> None:
        self.keys.append(key)
        self.hashes.append(hashes[:, : self.lanes])
        self.at.append(at.astype(np.uint32))
        self.copied.append(copied)
        self.held += len(at)

    def batch(self) -> pa.RecordBatch:
        names = ["bucket", "hashes", "keys", "counts", "at", "known", "hit_keys", "hit_counts", "hit_at"]
        rows: dict[int, dict[str, bytes]] = {}
        if self.held:
            hashes, at = np.concatenate(self.hashes), np.concatenate(self.at)
            text = np.repeat(np.arange(len(self.keys)), [len(x) for x in self.at])
            copied = np.array(self.copied)[text]
            order = np.lexsort(hashes.T[::-1])
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order[1:]] != hashes[order[:-1]]).any(1)
            group = np.cumsum(new) - 1
            count = np.bincount(group)
            again = np.empty(len(order), bool)
            again[order] = count[group] > 1
            first = np.zeros(len(order), bool)
            first[order[new]] = True
            bucket = _spread(hashes[:, 0], self.buckets)
            alone = np.flatnonzero(~again & ~copied)
            alone = alone[np.lexsort((text[alone], bucket[alone]))]
            for b, part in self._cut(bucket[alone], alone):
                rows.setdefault(b, {}).update(hashes=_packed_hashes(hashes[part]), **self._packed(part, text, at, ""))
            known = np.flatnonzero(first & (again | copied))
            known = known[np.argsort(bucket[known], kind="stable")]
            for b, part in self._cut(bucket[known], known):
                rows.setdefault(b, {}).update(known=_packed_hashes(hashes[part]))
            hit = np.flatnonzero(again & ~copied)
            home = text % self.buckets
            hit = hit[np.lexsort((text[hit], home[hit]))]
            for b, part in self._cut(home[hit], hit):
                rows.setdefault(b, {}).update(self._packed(part, text, at, "hit_"))
        self_rows = sorted(rows.items())
        self.clear()
        columns = [pa.array([b for b, _ in self_rows], pa.int32()), *[pa.array([r.get(n, b"") for _, r in self_rows], pa.binary()) for n in names[1:]]]
        return pa.RecordBatch.from_arrays(columns, names)

    @staticmethod
    def _cut(of: np.ndarray, what: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        begins, sizes = _runs(of)
        for s, n in zip(begins.tolist(), sizes.tolist()):
            yield int(of[s]), what[s : s + n]

    def _packed(self, part: np.ndarray, text: np.ndarray, at: np.ndarray, prefix: str) -> dict[str, bytes]:
        begins, sizes = _runs(text[part])
        return {f"{prefix}keys": b"".join([self.keys[i] for i in text[part[begins]].tolist()]), f"{prefix}counts": sizes.astype(np.uint32).tobytes(), f"{prefix}at": at[part].tobytes()}


PACKED = "bucket int, hashes binary, keys binary, counts binary, at binary, known binary, hit_keys binary, hit_counts binary, hit_at binary"


def repeated_entries(packed: DataFrame, lanes: int, buckets: int) -> DataFrame:
    """(key, at): for each text the positions of its entries whose hash occurs elsewhere too, one row per text.

    A bucket's finds leave it packed by the text's own bucket, where they are merged.
    """

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind: np.frombuffer(b"".join(rows[name]), kind)
        mine, known = (_unpacked(read(n, np.uint8), lanes) for n in ("hashes", "known"))
        every = np.concatenate([mine, known])
        order = np.lexsort(every.T[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (every[order[1:]] != every[order[:-1]]).any(1)
        group = np.cumsum(new) - 1
        again = np.zeros(len(order), bool)
        if len(order):
            again[order] = np.bincount(group)[group] > 1
        again = again[: len(mine)]
        counts, hit_counts = (read(n, np.uint32).astype(np.int64) for n in ("counts", "hit_counts"))
        text = np.repeat(np.arange(len(counts)), counts)
        keys = np.frombuffer(b"".join(rows["keys"]) + b"".join(rows["hit_keys"]), f"V{KEY}")
        counts = np.concatenate([np.bincount(text[again], minlength=len(counts)), hit_counts])
        at = np.concatenate([read("at", np.uint32)[again], read("hit_at", np.uint32)])
        home = np.frombuffer(keys.tobytes(), np.uint64)[::2] % np.uint64(buckets)
        by_home, out = np.argsort(home, kind="stable"), []
        entry_order = np.argsort(np.repeat(home, counts), kind="stable")
        keys, counts, home, at = keys[by_home], counts[by_home], home[by_home], at[entry_order]
        keep = counts > 0
        keys, counts, home = keys[keep], counts[keep], home[keep]
        begins, sizes = _runs(home)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for s, n in zip(begins.tolist(), sizes.tolist()):
            out.append((int(home[s]), keys[s : s + n].tobytes(), counts[s : s + n].astype(np.uint32).tobytes(), at[ends[s] : ends[s + n]].tobytes()))
        return pd.DataFrame(out, columns=["home", "keys", "counts", "at"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(rows["keys"]), f"V{KEY}")
        counts = np.frombuffer(b"".join(rows["counts"]), np.uint32).astype(np.int64)
        at = np.frombuffer(b"".join(rows["at"]), np.uint32)
        halves = np.frombuffer(keys.tobytes(), np.uint64).reshape(-1, 2)
        order = np.lexsort(halves.T)
        new = np.ones(len(order), bool)
        new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(1)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        at = at[np.argsort(np.repeat(place, counts), kind="stable")]
        ends = np.cumsum(np.bincount(place, counts).astype(np.int64)).tolist()
        return pd.DataFrame({"key": [k.tobytes() for k in keys[order[new]]], "at": [at[a:b].tobytes() for a, b in zip([0, *ends], ends)]})

    found = packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(settle, "home int, keys binary, counts binary, at binary")
    return found.repartition(buckets, "home").groupBy("home").applyInPandas(merge, "key binary NOT NULL, at binary")


def distinct_texts(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """(key, text, copies) for each distinct text, partitioned by key.

    A task counts copies over HELD_BYTES of texts at a time and keeps repeated ones on, so a text copied without end
    leaves a task about once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}
        held = 0

        def flush(texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(t.encode()).digest()[:KEY] for t in texts], pa.binary()), pa.array(texts, pa.string()), pa.array([count[t] for t in texts], pa.int64())],
                ["key", "text", "copies"],
            )

        for b in batches:
            for t in b.column(0).to_pylist():
                if t not in count:
                    held += len(t)
                count[t] = count.get(t, 0) + 1
            if held > HELD_BYTES:
                kept, room = {}, HELD_BYTES // 4
                for t, n in count.items():
                    if n > 1 and len(t) <= room:
                        kept[t] = n
                        room -= len(t)
                yield flush([t for t in count if t not in kept])
                count, held = kept, sum(map(len, kept))
        yield flush(list(count))

    rows = small_batches(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))
    # keys are declared NOT NULL: else an inner join would put a filter under the exchange, and it could not be reused
    dealt = rows.mapInArrow(run, "key binary NOT NULL, text string NOT NULL, copies long NOT NULL").repartition(parts, "key")
    return dealt.groupBy("key", "text").agg(F.sum("copies").alias("copies"))


def text_key(text):
    """The key of distinct_texts as a column expression."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 2 * KEY))


def _scanner(lanes: int, buckets: int, positions: Callable, size: int, window: int, settled: bool) -> Callable:
    """A mapInArrow function that hashes windows of `size` words at positions(words, row) of each text of a window or more.

    settled: a text with copies only makes its hashes known to others, since all of its own windows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Combiner(lanes, buckets)
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for key, text, copies, *more in zip(*columns):
                words = text.encode().split()
                if len(words) < window:
                    continue
                at = positions(len(words), *more)
                if len(at):
                    own.add(key, window_hashes(word_hashes(words), at, size), at, settled and copies > 1)
                if own.held >= BUCKET_ENTRIES:
                    yield own.batch()
        yield own.batch()

    return run


def _positions(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", np.uint32).astype(np.int64)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Per row the counts of words and removed words and the hash of the kept ones.

    The distinct texts are shuffled once by key; three passes read that exchange: anchors, windows near repeated
    anchors, and the removal.
    """
    if period != PERIOD or window <= PERIOD:
        raise ValueError("the cover is one of period 21, and a window must be longer")
    anchor = window - period + 1
    volume = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    entries = volume // WORD_BYTES
    texts = small_batches(distinct_texts(docs, text, max(1, -(-volume // TASK_BYTES))))

    buckets = max(1, -(-entries * len(COVER) // (PERIOD * BUCKET_ENTRIES)))
    anchors = texts.mapInArrow(_scanner(1, buckets, lambda n: cover_positions(n, anchor), anchor, window, False), PACKED)
    near = repeated_entries(anchors, 1, buckets)

    def around(n: int, packed: bytes) -> np.ndarray:
        """Starts of the windows that hold one of the anchors."""
        marks = np.zeros(n + 2, np.int64)
        at = _positions(packed)
        np.add.at(marks, np.maximum(at - (window - anchor), 0), 1)
        np.add.at(marks, at + 1, -1)
        return np.flatnonzero(np.cumsum(marks)[: n - window + 1])

    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    hashed = texts.join(near, "key").mapInArrow(_scanner(2, buckets, around, window, window, True), PACKED)
    repeats = repeated_entries(hashed, 2, buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n_words, n_removed, sha = b.column(0), [], [], []
            for t, copies, packed in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)]):
                words = t.encode().split()
                n = len(words)
                gone = np.full(n, copies > 1 and n >= window)
                at = _positions(packed)
                if len(at):
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + window, -1)
                    gone |= np.cumsum(marks)[:n] > 0
                removed = int(gone.sum())
                kept = words if not removed else [words[i] for i in np.flatnonzero(~gone).tolist()]
                n_words.append(n)
                n_removed.append(removed)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["key", "n_words", "n_removed", "kept_sha256"])

    done = texts.join(repeats, "key", "left").select("key", "text", "copies", "at").mapInArrow(cut, "key binary, n_words long, n_removed long, kept_sha256 string")
    rows = pick(docs, doc_id, text).toDF("doc_id", "_text").select("doc_id", text_key(F.col("_text")).alias("key"))
    return rows.join(done, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")
