"""Packing of token sequences: best fit, then swap-based local search.

Documents become ids, and pieces of at most `capacity` tokens. A full piece is a sequence of its own and meets no other.
The rest, at most one piece a document, are numbered as they are written and dealt to groups of about GROUP_DOCS by a
hash of the number, so the number of groups follows the table, each group fits one task, and repeated rows spread. In a
group, pieces are placed best-fit in decreasing order; a local search then takes the emptiest
sequence apart: its pieces move into other sequences, or are exchanged one-for-one, two-for-one or one-for-two against
smaller loads there. A step is taken only if it raises the sum of squared fills, that is if the other sequence becomes
fuller than the one taken apart was, so the search ends; a sequence that becomes empty is gone. Sequences that are left
loose in their groups are packed a second time, together.

Columns of pack_documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

Defined cases: a null text counts as empty and gives one piece that holds the end id alone; only documents longer than
`capacity` are cut, into full pieces and a last one that may be shorter; repeated rows are packed each; an empty table
gives an empty result; any further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import checkpointed, pick, small_batches, tidy

#: Pieces that are not full per packing group, on average.
GROUP_DOCS = 16_384
#: Words, and pre-tokens, in one generation of a worker's caches; and the bytes of the longest word kept.
CACHE_ENTRIES = 150_000
LONGEST_KEPT = 64
#: Sequences that the local search tries to empty in a group before it gives up in a row.
TRIES = 64
#: Pieces of the emptied sequence, the largest ones, from which pairs are exchanged for one; and the most pieces of a
#: sequence from which two are taken for one. The bounds limit the search's tries; every piece is packed.
PAIRS_GIVEN, PAIRS_TAKEN = 12, 24
#: Sequences with a larger free share than this are packed again together with those of other groups.
LOOSE = 0.125
_LETTERS, _NUMBERS = ("".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
#: A word that normalising only lower-cases, without the marks that special tokens begin with.
_LATIN_WORD = re.compile(r"(?:[\x00-\xff](?<!<\|))*")
#: Fixed value: the vocabulary's pre-tokens, within Latin-1.
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\x09-\x0d \x85\xa0{_LETTERS}{_NUMBERS}]+")


def byte_stand_ins() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as U+0100 onwards, in order."""
    rest = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids of texts as the tokenizers library gives them, remembered by blank-separated word.

    The vocabulary's tokens never cross white space and its normaliser works within words, so a text's ids are the ids
    of its words one after another. A new word within Latin-1, which the normaliser only lower-cases, is cut into the
    vocabulary's pre-tokens, and new pre-tokens go to the library's model; any other new word goes through the whole
    tokenizer. Both caches keep two generations, so that filling up never forgets the words in use.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.stands = byte_stand_ins()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.older_parts.get(part)
        if ids is None:
            found = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.stands))]
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.parts) >= CACHE_ENTRIES:
            self.older_parts, self.parts = self.parts, {}
        self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            text = word.decode("utf-8", "replace")
            if _LATIN_WORD.fullmatch(text):
                ids = b"".join([self.parts.get(p) or self._part(p) for p in _PRETOKENS.findall(text.lower())])
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.known) >= CACHE_ENTRIES:
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        make = self._word
        for t in texts:
            words = t.encode().split()
            known = self.known
            yield b"".join([known[w] if w in known else make(w) for w in words])


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This process's cache for a vocabulary file; a worker keeps it from task to task."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def pack_lengths(lengths: np.ndarray, capacity: int, tries: int = TRIES) -> tuple[np.ndarray, np.ndarray]:
    """The sequence number and the offset of each piece. Sequence numbers are gapless from 0."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    sizes = lengths.tolist()
    bins: list[list[int]] = []
    free: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by free tokens
    some = 0  # bit r: a sequence with r free tokens is open
    for i in order.tolist():
        size = sizes[i]
        fitting = some >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            b, r = len(bins), capacity
            bins.append([])
            free.append(capacity)
        bins[b].append(i)
        free[b] = left = r - size
        if left:
            room[left].append(b)
            some |= 1 << left
    _empty_sequences(bins, free, sizes, capacity, tries)
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    number = 0
    for own in bins:
        at = 0
        for i in sorted(own):
            sequence[i], offset[i] = number, at
            at += sizes[i]
        number += bool(own)
    return sequence, offset


def _empty_sequences(bins: list[list[int]], free: list[int], sizes: list[int], capacity: int, tries: int) -> None:
    """Take the emptiest sequence apart, again and again, until none of `tries` in a row empties or the bound is met."""
    least = -(-sum(sizes) // capacity)
    count = sum(1 for b in bins if b)
    tried: set[int] = set()
    failed = 0
    while count > least and failed < tries:
        donors = [b for b in range(len(bins)) if bins[b] and b not in tried]
        if not donors:
            return
        donor = max(donors, key=lambda b: (free[b], b))
        if _take_apart(donor, bins, free, sizes):
            count, failed = count - 1, 0
            tried.clear()
        else:
            tried.add(donor)
            failed += 1


def _take_apart(donor: int, bins: list[list[int]], free: list[int], sizes: list[int]) -> bool:
    """Improve other sequences with the donor's pieces while any step raises the squared fill; True if it is empty then."""
    open_ = [b for b in range(len(bins)) if b != donor and bins[b] and free[b]]
    while bins[donor]:
        step = _best_step(donor, open_, bins, free, sizes)
        if step is None:
            return False
        other, given, taken = step
        gain = sum(sizes[i] for i in given) - sum(sizes[i] for i in taken)
        for i in given:
            bins[donor].remove(i)
            bins[other].append(i)
        for i in taken:
            bins[other].remove(i)
            bins[donor].append(i)
        free[other] -= gain
        free[donor] += gain
        if not free[other]:
            open_.remove(other)
    return True


def _best_step(donor: int, open_: list[int], bins: list[list[int]], free: list[int], sizes: list[int]) -> tuple[int, list[int], list[int]] | None:
    """The step with the largest gain of the receiver: a move, else an exchange one-for-one, two-for-one or one-for-two."""
    mine = sorted(bins[donor], key=lambda i: -sizes[i])
    given = [([i], sizes[i]) for i in mine]
    given += [([i, j], sizes[i] + sizes[j]) for k, i in enumerate(mine[:PAIRS_GIVEN]) for j in mine[k + 1 : PAIRS_GIVEN]]
    best, gained, mass = None, 0, -1
    own_fill = sum(sizes[i] for i in mine)
    fills = [sum(sizes[i] for i in bins[b]) for b in open_]
    for b, full in zip(open_, fills):
        room = free[b]
        for own, weight in given:
            if gained < weight <= room and full + weight > own_fill:
                best, gained = (b, own, []), weight
    if best is not None:
        return best
    for b, full in zip(open_, fills):
        room = free[b]
        theirs = bins[b]
        out = [([i], sizes[i]) for i in theirs]
        if len(theirs) <= PAIRS_TAKEN:
            out += [([i, j], sizes[i] + sizes[j]) for k, i in enumerate(theirs) for j in theirs[k + 1 :]]
        for own, weight in given:
            for other, light in out:
                gain = weight - light
                if 0 < gain <= room and len(own) + len(other) <= 3 and full + gain > own_fill and (gain, full) > (gained, mass):
                    best, gained, mass = (b, own, other), gain, full
    return best


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = array("I", [end_id]).tobytes() if array("I").itemsize == 4 else np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for b in batches:
            row, piece, start, length, crc = [], array("i"), array("q"), array("q"), array("q")
            for r, ids in enumerate(known.batch([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(np.array(x, np.int32 if x is piece else np.int64)) for x in (piece, start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", group_docs: int = GROUP_DOCS) -> DataFrame:
    """Tokenise in the scan, write the pieces' numbers, and pack each group in one task."""
    pieces = pieces_of(docs, path, capacity, end_id, doc_id, text)
    names = [*pieces.columns, "sequence_id", "offset"]
    every = checkpointed(pieces.withColumn("_n", F.monotonically_increasing_id()))
    full, rest = every.where(F.col("length") == capacity), every.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_docs))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], kind="stable", ignore_index=True)
        sequence, rows["offset"] = pack_lengths(rows["length"].to_numpy(), capacity)
        rows["_loose"] = (np.bincount(sequence, rows["length"]) < (1 - LOOSE) * capacity)[sequence]
        rows["sequence_id"] = (rows.pop("_group").to_numpy() << 32) + sequence
        return rows[[*names, "_n", "_loose"]]

    def packed(rows: DataFrame, first: int, number: int) -> DataFrame:
        dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_n"), F.lit(number)).cast("long") + first)
        kinds = ", ".join(f"{c} {every.schema[c].dataType.simpleString()}" for c in pieces.columns)
        return dealt.groupBy("_group").applyInPandas(pack, f"{kinds}, sequence_id long, offset long, _n long, _loose boolean")

    alone = full.select(*pieces.columns, (-1 - F.col("_n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if groups == 1:
        return alone.unionByName(packed(rest, 0, 1).select(names))
    first = checkpointed(packed(rest, 0, groups))
    # Each group ends with a sequence or two that are not full; those of many groups fill each other.
    loose = first.where("_loose").drop("sequence_id", "offset", "_loose")
    second = packed(loose, groups, max(1, -(-loose.count() // group_docs)))
    return alone.unionByName(first.where("NOT _loose").select(names)).unionByName(second.select(names))
