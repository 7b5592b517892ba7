"""Token counts by a trie with shared forward scores.

Under a unigram vocabulary the best segmentation of a pre-token is a shortest-path problem over its prefixes: the
forward score of a prefix is the best, over tokens that end there, of the score of the shorter prefix plus the
token's. That score depends on the prefix alone, so distinct pre-tokens are inserted in a trie and each node's score
is computed once, however many pre-tokens share it; terminals keep the token count of their best path.

The vocabulary is a public piece model; a piece's log-probability is given by its place in the file under Zipf's law,
-log(place + ZIPF_SHIFT), and characters without a piece fall back to one token per UTF-8 byte at BYTE_PENALTY each.
Of equally good paths the one with fewer tokens counts, then the one with the longer last token.

Columns of count_tokens: doc_id, n_tokens, n_pretokens, n_bytes.

Defined cases: a null text counts as empty and has 0 of everything; pre-tokens are separated by white space and start
with the vocabulary's blank mark; repeated rows are counted each; an empty table gives an empty result; any further
columns are ignored. Texts are taken whole; a pre-token longer than LONG characters is scored outside the trie with
memory in proportion to its own length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vitalframe.llm.common import pick, small_batches

#: Fixed value: the mark of a preceding blank in the vocabulary.
BLANK = "▁"
ZIPF_SHIFT = 10.0
BYTE_PENALTY = -16.0
#: Nodes that a worker's trie may have before it starts anew.
TRIE_NODES = 600_000
#: Characters of the longest pre-token that the trie takes.
LONG = 64


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a public model, special and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(place + ZIPF_SHIFT) for place, i in enumerate(plain, 1)}


class ForwardTrie:
    """A trie of pre-tokens. Per node: the forward score, the tokens on its best path, and its text's last characters."""

    def __init__(self, scores: dict[str, float], most_nodes: int = TRIE_NODES):
        self.pieces, self.most = scores, most_nodes
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | code point: node
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _extend(self, text: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Forward score and token count of text[:end], from those of its prefixes."""
        own = len(text[end - 1].encode("utf-8", "replace"))
        top, count = best[end - 1] + own * BYTE_PENALTY, tokens[end - 1] + own
        pieces = self.pieces
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            score = pieces.get(text[start:end])
            if score is not None:
                score += best[start]
                if score > top or score == top and tokens[start] + 1 <= count:
                    top, count = score, tokens[start] + 1
        return top, count

    def count(self, text: str) -> int:
        """Tokens of a pre-token's best path; inserts it."""
        if len(text) > LONG:
            best, tokens = [0.0], [0]
            for end in range(1, len(text) + 1):
                b, t = self._extend(text, end, best, tokens)
                best.append(b)
                tokens.append(t)
            return tokens[-1]
        if len(self.best) + len(text) > self.most:
            self.clear()
        node, child = 0, self.child
        best, tokens = [0.0], [0]
        for end, c in enumerate(text, 1):
            key = node << 21 | ord(c)
            node = child.get(key, -1)
            if node < 0:
                b, t = self._extend(text, end, best, tokens)
                node = child[key] = len(self.best)
                self.best.append(b)
                self.tokens.append(t)
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        self.terminal[text] = tokens[-1]
        return tokens[-1]


_TRIES: dict[str, ForwardTrie] = {}


def trie_of(path: str) -> ForwardTrie:
    """This process's trie for a vocabulary file; a worker keeps it from task to task."""
    if path not in _TRIES:
        _TRIES[path] = ForwardTrie(piece_scores(path))
    return _TRIES[path]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Count inside the scan tasks: nothing is shuffled, and the trie's size is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path)
        for b in batches:
            n_tokens, n_words, n_bytes = [], [], []
            for t in b.column(1).to_pylist():
                words = (t or "").split()
                total = 0
                known = trie.terminal.get
                for w in words:
                    n = known(BLANK + w)
                    if n is None:
                        n = trie.count(BLANK + w)
                        known = trie.terminal.get
                    total += n
                n_tokens.append(total)
                n_words.append(len(words))
                n_bytes.append(len((t or "").encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (n_tokens, n_words, n_bytes)]], ["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_pretokens long, n_bytes long")
