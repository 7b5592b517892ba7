"""Decontamination against brute force over all windows."""

import hashlib
import re

import numpy as np
import pytest

from vitalframe.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def brute(rows, items, window):
    known = {}
    for i, t in items:
        w = words_of(t)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            known.setdefault(tuple(w[s : s + size]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, ids = words_of(t), set(), set()
        for size in range(1, window + 1):
            for s in range(len(w) - size + 1):
                own = known.get(tuple(w[s : s + size]))
                if own is not None:
                    hit |= set(range(s, s + size))
                    ids |= own
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(docs, items, window):
    rows = op.find_contamination(docs, items, window=window)
    assert rows.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark, texts):
    long = next(t for t in texts if t and len(t) > 100_000)
    made = [
        (10, texts[9]), (9, texts[9]), (2, " ".join(long.split()[500:560]).upper()), (3, "z A. b! c"), (4, None), (5, " ,;. "), (6, "groß"), (None, texts[12]), (7, texts[10]), (7, texts[11]),
        (8, "中文 字"), (11, "w1 w2 w3 w4 w5 w6 w7 w8 w9 nowhere w1"), (12, " ".join(texts[14].split()[:10])), (13, "x" * 5000),
    ]
    return spark.createDataFrame(made, "item_id long, text string").selectExpr("*", "'k' AS words", "1 AS print"), made


@pytest.mark.parametrize("window", [10, 3, 1])
def test_equals_brute_force(docs, rows, items, window):
    got = found(docs, items[0], window)
    assert got == brute(rows, items[1], window)
    assert sum(r[5] for r in got) > 5


def test_empty_tables(docs, rows, empty, items):
    assert found(empty, items[0], 10) == []
    assert found(docs, items[0].limit(0), 10) == brute(rows, [], 10)


def test_a_passage_in_every_document(spark):
    shared = " ".join(f"p{i}" for i in range(40))
    made = [(i, f"own{i} {shared} end{i}" if i % 3 else shared) for i in range(300)]
    items = [(k, f"{k} {shared}") for k in range(20)]
    assert found(spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10) == brute(made, items, 10)


def test_equal_windows_keep_equal_fingerprints():
    rng = np.random.default_rng(3)
    for window in range(1, 12):
        text = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        starts, prints = op.fingerprints(text, np.full(200, 200), window)
        assert starts.tolist() == list(range(200 - window + 1))
        for s in (0, 17, 200 - window):
            alone = op.fingerprints(text[s : s + window], np.full(window, window), window)[1]
            assert alone.tolist() == [prints[s]]
    # windows never cross from one text to the next, and few grams are kept
    starts, prints = op.fingerprints(text, np.repeat([120, 200], [120, 80]), 10)
    assert not set(range(111, 120)) & set(starts.tolist()) and len(set(prints.tolist())) < 90
