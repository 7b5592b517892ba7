"""Near copies by shingle similarity against brute force."""

import random
from itertools import combinations

import corpus_pipeline
import pytest
from vitalframe.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similar(x, y):
    a, b = set(jaccard.shingles(x, 5).tolist()), set(jaccard.shingles(y, 5).tolist())
    return bool(a and b) and len(a & b) * 5 >= len(a | b) * 4


def kept(rows):
    """(doc_id, text) of the rows that brute force keeps."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if similar(rows[i][1], rows[j][1]):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (r[0] is None, r[0] or 0))
    return sorted((r for i, r in enumerate(rows) if least[find(i)] == (r[0] is None, r[0] or 0)), key=str)


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "x" + str(rng.randrange(10**6))
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Near copies on both sides of the limit, chains, a passage in many texts and a large group of near copies."""
    rng = random.Random(5)
    say = lambda n: " ".join("w" + str(rng.randrange(5000)) for _ in range(n))
    out = [None, "", "a", "a b", "A  B", "a b c d e"]
    for n in (30, 80, 200, 600):
        for _ in range(4):
            text = say(n)
            out += [text, *[edited(rng, text, k) for k in (1, 2, 3, n // 40)], text + " " + say(n // 8)]
    passage, common = say(40), say(150)
    out += [passage + " " + say(rng.randrange(5, 60)) for _ in range(60)]
    out += [edited(rng, common, rng.randrange(1, 6)) for _ in range(60)]
    chain = say(100)
    for _ in range(6):
        out.append(chain)
        chain = edited(rng, chain, 2)
    return [((i * 101) % len(out), t) for i, t in enumerate(out)]


@pytest.mark.parametrize("bucket", [32, 2])
def test_similarity_matches_brute_force(spark, rows, bucket):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    out = simhash.keep_first(docs, pair_bucket=bucket)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == kept(rows)


def test_stage_drops_small_edits(spark):
    rng = random.Random(3)
    text = " ".join("w" + str(rng.randrange(900)) for _ in range(80))
    rows = [(1, text), (103, text + " me@here.org"), (104, edited(rng, text, 1)), (7, " ".join(reversed(text.split())))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], SCHEMA), "")
    assert {r["doc_id"] for r in out.collect()} == {1, 7}


def test_repeated_and_null_ids(spark):
    rng = random.Random(4)
    near, other = [" ".join("w" + str(rng.randrange(900)) for _ in range(80)) for _ in range(2)]
    docs = spark.createDataFrame([(1, near, "aa", "s", 0), (2, near + " x", "aa", "s", 0), (2, other, "aa", "s", 0), (None, other + " x", "aa", "s", 0), (None, near[:-1], "aa", "s", 0)], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_first(docs).collect()) == [(1, near), (2, other)]


def test_empty(spark):
    assert simhash.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0
