"""Language identification by a multilingual mixture.

Training counts hashed byte trigrams per language over all labelled training documents, in the scan tasks, and gives
smoothed log-likelihoods. For a document every word has a likelihood under each language, the sum over its trigrams;
expectation-maximisation estimates the document's language proportions from them, as if each word were drawn from one
language. Sets of the strongest languages are then compared by penalised likelihood (twice the log-likelihood less
PENALTY * log(words) for each further language), and the largest proportion within the chosen set wins.

Columns of predict_languages: doc_id, held_out, lang_pred, score, languages (the chosen set with proportions).

Defined cases: a text that is null or has no letter gives 'und' with score 0, as does every text if no language was
learned; a null doc_id is not held out; documents whose lang is null are not learned from; languages with equal
proportions are taken in alphabetical order; an empty table gives an empty result; any further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import pick, small_batches, tidy

#: Hash buckets of trigrams.
BUCKETS = 1 << 15
#: Languages that a document's set may hold.
MOST_IN_SET = 4
#: EM steps over all languages, and over each smaller set.
STEPS, SET_STEPS = 12, 5
#: Weight of the penalty log(words) for each further language in a set.
PENALTY = 3.0
#: Added to every count.
SMOOTHING = 0.5
#: Share of a word's likelihood that is spread evenly over languages, so that odd words cannot decide alone.
FLOOR = 1e-4
UNDETERMINED = "und"

_WORD_CHARACTER = re.compile(r"[^\W\d_]")
#: ASCII characters that are no letters become blanks.
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MIX = np.uint32(2654435761)  # Fixed value: the golden ratio's multiplier for 32-bit multiplicative hashing


def has_letter(text: str | None) -> bool:
    """Whether a character is of Unicode category L; number-like word characters such as fractions are none."""
    return bool(text) and any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(text))


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BLANKS).split()


def _trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram of the words, each framed by blanks, and where each word's trigrams begin."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code = code[raw[1:-1] != 32]  # a trigram is centred in its word
    bucket = ((code * _MIX) >> np.uint32(17)).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return bucket, np.cumsum(sizes) - sizes


@dataclass
class Model:
    """languages in alphabetical order; scores: log-likelihood of a trigram's bucket under each, (BUCKETS, languages)."""

    languages: list[str]
    scores: np.ndarray


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts over all training documents. A task sends one row per language and bucket that it met; the
    counts that reach the driver are at most BUCKETS per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letter(t) and (words := _words(t)):
                    own = counts.setdefault(label, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(_trigrams(words)[0], minlength=BUCKETS)
        for label, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.where(F.col(f"`{lang}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`"))).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    found = small_batches(rows).mapInArrow(tidy(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    labels = found.column("lang").to_pylist()
    languages = sorted(set(labels))
    place = {x: i for i, x in enumerate(languages)}
    table = np.zeros((BUCKETS, len(languages)))
    table[found.column("bucket").to_numpy(), np.array([place[x] for x in labels], np.int64)] = found.column("n").to_numpy()
    table += SMOOTHING
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def _em(weight: np.ndarray, starts: np.ndarray, counts: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after some EM steps, and its log-likelihood (up to the words' own scale) before the last."""
    of_word = np.repeat(np.arange(len(starts)), counts)
    total = np.zeros(len(starts))
    for _ in range(steps):
        joint = weight * share[of_word]
        mass = joint.sum(1)
        total = np.add.reduceat(np.log(mass), starts)
        share = np.add.reduceat(joint / mass[:, None], starts) / counts[:, None]
    return share, total


def mixtures(texts: list[list[bytes]], model: Model) -> Iterator[tuple[list[str], list[float], float]]:
    """The language set of each text, a non-empty list of words, the proportions in it, the largest first, and the share
    of the mixture over all languages that the set has."""
    counts = np.array([len(t) for t in texts])
    starts = np.cumsum(counts) - counts
    bucket, begins = _trigrams([w for t in texts for w in t])
    loglik = np.add.reduceat(model.scores[bucket], begins).astype(np.float64)
    weight = np.exp(loglik - loglik.max(1, keepdims=True)) + FLOOR
    n, most = weight.shape[1], min(MOST_IN_SET, weight.shape[1])
    share, _ = _em(weight, starts, counts, np.full((len(texts), n), 1.0 / n), STEPS)
    top = np.argsort(-share, axis=1, kind="stable")[:, :most]
    near = np.take_along_axis(weight, np.repeat(top, counts, axis=0), axis=1)
    first = np.maximum(np.take_along_axis(share, top, axis=1), 1e-9)
    best = np.full(len(texts), -np.inf)
    chosen, mixed = np.ones(len(texts), np.int64), np.zeros((len(texts), most))
    for k in range(1, most + 1):
        own, total = _em(near[:, :k], starts, counts, first[:, :k] / first[:, :k].sum(1, keepdims=True), SET_STEPS if k > 1 else 1)
        score = 2 * total - PENALTY * (k - 1) * np.log(counts + 1)
        better = score > best
        best[better], chosen[better] = score[better], k
        mixed[better] = 0
        mixed[better, :k] = own[better]
    for t, k, m, f in zip(top.tolist(), chosen.tolist(), mixed, first):
        order = sorted(range(k), key=lambda i: (-m[i], t[i]))
        yield [model.languages[t[i]] for i in order], [float(min(1.0, m[i])) for i in order], float(f[:k].sum())


def predict_languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", chunk: int = 1 << 18) -> DataFrame:
    """Predict every text inside its own scan task from the text alone; the model's size is BUCKETS times languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score, names = [UNDETERMINED] * len(texts), [0.0] * len(texts), [""] * len(texts)
            rows, some, held = [], [], 0

            def settle() -> None:
                for r, (languages, shares, _) in zip(rows, mixtures(some, model)):
                    pred[r], score[r] = languages[0], shares[0]
                    names[r] = ",".join(f"{x}:{s:.3f}" for x, s in zip(languages, shares))

            for r, t in enumerate(texts):
                if model.languages and has_letter(t) and (words := _words(t)):
                    rows.append(r)
                    some.append(words)
                    held += len(t)
                    if held >= chunk:
                        settle()
                        rows, some, held = [], [], 0
            if rows:
                settle()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, languages string")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    return predict_languages(docs, train(docs, doc_id, text, lang), doc_id, text)


def keep_identified(docs: DataFrame, model: Model, least_share: float, text: str = "text", chunk: int = 1 << 18) -> DataFrame:
    """The input's rows, all columns unchanged, whose text has a letter and whose language set, of one or several
    languages, has a share of least_share or more of the mixture. If no language was learned, every text with a letter stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            keep, rows, some, held = np.zeros(b.num_rows, bool), [], [], 0

            def settle() -> None:
                for r, (_, _, share) in zip(rows, mixtures(some, model)):
                    keep[r] = share >= least_share

            for r, t in enumerate(b.column(place).to_pylist()):
                if not has_letter(t):
                    continue
                keep[r] = not model.languages
                if model.languages and (words := _words(t)):
                    rows.append(r)
                    some.append(words)
                    held += len(t)
                    if held >= chunk:
                        settle()
                        rows, some, held = [], [], 0
            if rows:
                settle()
            yield b.filter(pa.array(keep))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)
