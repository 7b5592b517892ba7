"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from vitalframe.llm import resampling as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def features(text, longest, buckets):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[a : a + n]).encode()) % buckets for n in range(1, longest + 1) for a in range(len(w) - n + 1)]


def brute(rows, target, longest, buckets, least, percent):
    corpus, goal = Counter(), Counter()
    for _, t in rows:
        corpus.update(features(t, longest, buckets))
    for t in target:
        goal.update(features(t, longest, buckets))
    all_s, all_t, made = sum(corpus.values()), sum(goal.values()), []
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (all_s + buckets) / ((corpus[b] + 1) * (all_t + buckets))))
    for i, t in rows:
        own = features(t, longest, buckets)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made.append((i, len(own), weight, score, len(words_of(t)) >= least))
    order = sorted((r for r in made if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: percent * len(order) // 100]
    return made, [(r[0], r[3], k + 1) for k, r in enumerate(drawn)]


@pytest.fixture(scope="module")
def target(spark, texts):
    made = [texts[20], None, "", " ".join(texts[21:30]), "é É"]
    return spark.createDataFrame([(t,) for t in made], "text string").selectExpr("*", "3 AS n_words"), made


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (1, 7, 60), (3, 10_000, 35), (2, 65_536, 100), (1, 10_000, 0)])
def test_equals_brute_force(docs, rows, target, longest, buckets, percent):
    made = op.resample_documents(docs, target[0], longest=longest, buckets=buckets, percent=percent)
    assert made.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = made.collect()
    want, drawn = brute(rows, target[1], longest, buckets, 20, percent)
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in want), key=str)
    assert sorted(((r["doc_id"], r["score"], r["rank"]) for r in got if r["rank"]), key=str) == sorted(drawn, key=str)


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "CAST(30 AS long) AS n_words", "CAST(id DIV 20 AS long) AS score")
    got = {r["doc_id"]: r["rank"] for r in op.drawn_ranks(docs, 30, 20).collect()}
    assert {i: k for i, k in got.items() if k} == {i: p + 1 for p, i in enumerate([*range(40, 50), *range(20, 25)])}
    assert not any(r["rank"] for r in op.drawn_ranks(docs, 30, 31).collect())


def test_empty_tables(spark, docs, rows, empty, target):
    assert op.resample_documents(empty, target[0]).collect() == []
    got = op.resample_documents(docs, target[0].limit(0)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted((r[:4] for r in brute(rows, [], 1, 10_000, 20, 10)[0]), key=str)
    with pytest.raises(ValueError):
        op.resample_documents(docs, target[0], buckets=1 << 17)


def test_ring_checks_sums_of_runs():
    words = [b"a", b"bc", b"", "é".encode(), b"a"]
    for longest in (1, 2, 3, 9):
        want = [zlib.crc32(b" ".join(words[a : b + 1])) % 997 for b in range(len(words)) for a in range(max(0, b - longest + 1), b + 1)]
        assert op.ring_buckets(words, longest, 997, op.WordChecksums()).tolist() == want
