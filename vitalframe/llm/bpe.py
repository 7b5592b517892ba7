"""BPE encoding and decoding by per-prefix dynamic programming.

For a byte-pair vocabulary, the encoding of every prefix of a pre-token has one last token, and it is enough to store
that token for each prefix (Aho-Corasick / suffix-automaton style encoder of "So many tokens, so little time", public).
At each end position the tokens that are suffixes of the prefix come from an automaton over the vocabulary, longest
first; a candidate is the last token if the last token of the shorter prefix is compatible with it, that is, if the
pair, merged from its own bytes, would stay these two tokens. Back-pointers then give the exact ids.

The pair test undoes the merges of the two tokens from the latest on and looks whether an earlier merge would have
joined them across the border.

Columns of encode_documents: doc_id, n_tokens, ids_sha256, decoded_sha256.

Defined cases: a null text counts as empty (0 tokens, hashes of the empty string); special strings in a text become
their ids, as the library does; repeated rows are encoded each; any further columns are ignored; an empty table gives
an empty result. A text is processed whole; a long pre-token costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vitalframe.llm.common import pick, small_batches

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that each generation of a worker's caches may hold.
CACHE_ENTRIES = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 characters stand for their own code, the others take U+0100 onwards in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """A byte-level BPE vocabulary with its merge order; encodes one pre-token's bytes at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stands = byte_alphabet()
        as_bytes = lambda token: bytes(stands[c] for c in token)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.tokens = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # a pair of ids: its merge's place and the id it gives
        self.parts: dict[int, tuple[int, int, int]] = {}  # an id: its merge's place and the two ids it comes from
        for place, pair in enumerate(model["merges"]):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = (place, whole)
            self.parts.setdefault(whole, (place, a, b))
        self.size = {i: len(b) for i, b in self.tokens.items()}
        self.fits: dict[int, bool] = {}
        self.stable: dict[int, bool] = {}
        self.stable = {i: True for i in self.ids.values() if self._reachable(i)}  # tokens that their own bytes encode to
        self._automaton()
        split = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.specials = re.compile(f"({split})") if split else None

    def _automaton(self) -> None:
        """Goto table over token bytes with suffix links; out[state] is the longest token ending there, shorter[state] the state of the next shorter one."""
        go: list[dict[int, int]] = [{}]
        token = [-1]
        for piece, i in self.ids.items():
            if i not in self.stable:
                continue  # never part of an encoding
            s = 0
            for byte in piece:
                t = go[s].get(byte)
                if t is None:
                    t = go[s][byte] = len(go)
                    go.append({})
                    token.append(-1)
                s = t
            token[s] = i
        link, nearest = [0] * len(go), [0] * len(go)
        queue = list(go[0].values())
        for s in queue:
            for byte, t in go[s].items():
                f = link[s]
                while f and byte not in go[f]:
                    f = link[f]
                link[t] = go[f].get(byte, 0) if s else 0
                queue.append(t)
            nearest[s] = link[s] if token[link[s]] >= 0 else nearest[link[s]]
        self.go, self.token, self.link, self.nearest = go, token, link, nearest

    def compatible(self, key: int) -> bool:
        """Whether the bytes of two tokens, left << 32 | right, encode to just these two.

        Tokens are taken apart at the border in reverse merge order. While one side is split, the piece next to the
        border must not have had an earlier merge with the other side's piece.
        """
        a, b, limit, fits = key >> 32, key & 0xFFFFFFFF, len(self.rank) + 1, True
        while True:
            joined = self.rank.get((a, b))
            if joined is not None and joined[0] < limit:
                fits = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            # The side formed last is undone first; at one place the leftmost merge came first, so the right side is undone.
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                limit, a = pa_[0], pa_[2]
            else:
                limit, b = pb[0] + 1, pb[1]  # a merge at the same place further left came before it
        if len(self.fits) >= 4 * CACHE_ENTRIES:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ids.get(piece)
        if whole is not None and whole in self.stable:
            return [whole]
        go, token, link, nearest, size, fits = self.go, self.token, self.link, self.nearest, self.size, self.fits
        last: list[int] = []
        state = 0
        for end, byte in enumerate(piece, 1):
            step = go[state].get(byte)
            if step is None:
                s = state
                while step is None and s:
                    s = link[s]
                    step = go[s].get(byte)
                step = go[state][byte] = step or 0  # the automaton is built; steps over suffix links are kept
            state = step
            s = state if token[state] >= 0 else nearest[state]
            while True:
                t = token[s]
                start = end - size[t]
                if not start:
                    break
                key = last[start - 1] << 32 | t
                fit = fits.get(key)
                if fit is None:
                    fit = self.compatible(key)
                if fit:
                    break
                s = nearest[s]
            last.append(t)
        out, at = [], len(piece)
        while at:
            t = last[at - 1]
            out.append(t)
            at -= size[t]
        return out[::-1]

    def _reachable(self, t: int) -> bool:
        """Whether a token's own bytes encode to it: its two parts are reachable and nothing joins earlier across them."""
        known = self.stable.get(t)
        if known is None:
            part = self.parts.get(t)
            if part is None:
                known = len(self.tokens[t]) == 1
            else:
                place, a, b = part
                known = self._reachable(a) and self._reachable(b) and self._joins_last(a, b, place)
            self.stable[t] = known
        return known

    def _joins_last(self, a: int, b: int, place: int) -> bool:
        """Whether the pair's own merge is the first that crosses its border."""
        limit = place
        while True:
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or (pa_ is not None and pa_[0] > pb[0]):
                limit, a = pa_[0], pa_[2]
            else:
                limit, b = pb[0] + 1, pb[1]
            joined = self.rank.get((a, b))
            if joined is not None and joined[0] < limit:
                return False

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _class_of(first: str, most: int) -> str:
    """A character class with the characters up to `most` whose category starts with `first`."""
    return "".join(re.escape(chr(c)) for c in range(most) if unicodedata.category(chr(c)).startswith(first))


_LETTER, _NUMBER, _SPACE = _class_of("L", 256), _class_of("N", 256), "\t\n\x0b\x0c\r \x85\xa0"
#: The same split for texts within Latin-1, where the standard library's engine needs no tables.
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ANY = regex.compile(PATTERN)
#: A blank between two other characters always starts a pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD_BLANK = re.compile(r"\s\s|^ | $")


def pretokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ANY.findall(text)
    return _LATIN.findall(text)


class Codec:
    """encode and decode texts with caches over chunks: a blank and the characters up to the next lone blank."""

    def __init__(self, path: str):
        self.bpe = PrefixEncoder(path)
        self.chunks: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.pieces: dict[str, list[int]] = {}

    def ids_of(self, text: str) -> list[int]:
        """The ids of a text without special strings."""
        out: list[int] = []
        pieces, found = self.pieces, pretokens(text)
        if len(found) == 1:  # the chunk itself is kept
            return self.bpe.encode(text.encode())
        for p in found:
            ids = pieces.get(p)
            if ids is None:
                ids = self.bpe.encode(p.encode())
                if len(p) <= 64:
                    if len(pieces) >= CACHE_ENTRIES:
                        pieces.clear()
                    pieces[p] = ids
            out += ids
        return out

    def _chunk(self, text: str) -> tuple[int, str, bytes]:
        made = self.older.get(text)
        if made is None:
            ids = self.ids_of(text)
            made = (len(ids), ",".join(map(str, ids)), self.bpe.decode(ids))
        if len(text) <= 64:
            if len(self.chunks) >= CACHE_ENTRIES:
                self.older, self.chunks = self.chunks, {}
            self.chunks[text] = made
        return made

    def _plain(self, text: str) -> list[tuple[int, str, bytes]]:
        parts = _CUT.split(text) if _ODD_BLANK.search(text) else text.split(" ")
        known, make = self.chunks, self._chunk
        keys = [parts[0], *[" " + p for p in parts[1:]]]
        if len(known) + len(keys) > CACHE_ENTRIES:  # the cache may change hands on the way
            return [self.chunks.get(k) or make(k) for k in keys if k]
        return [known[k] if k in known else make(k) for k in keys if k]

    def digest(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the SHA-256 of the decimal ids joined by commas, and that of the decoded text."""
        done: list[tuple[int, str, bytes]] = []
        special = self.bpe.special
        parts = self.bpe.specials.split(text) if self.bpe.specials else [text]
        for p in parts:
            if p in special:
                done.append((1, str(special[p]), p.encode()))
            elif p:
                done += self._plain(p)
        decoded = b"".join([d[2] for d in done]).decode("utf-8", "replace")
        return sum([d[0] for d in done]), hashlib.sha256(",".join([d[1] for d in done]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This process's codec of a vocabulary file; a worker keeps it from task to task."""
    if path not in _CODECS:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text inside its own scan task: no shuffle, no state beyond the bounded caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            rows = [own.digest(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
