"""Language ID against expectation-maximisation written out for one document at a time."""

import math
import random
import re

import numpy as np

from vitalframe.llm import langid as op

PARTS = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["sch", "ung", "zei", "kt"], "cc": ["qu", "ei", "ou", "x"], "dd": ["å", "ñu", "vo", "z"]}


def say(rng, lang, n):
    return [("".join(rng.choices(PARTS[lang], k=3))) for _ in range(n)]


def steps(weights, share, n):
    """Shares after n steps, and the log-likelihood before the last one."""
    total = 0.0
    for _ in range(n):
        gained, total = [0.0] * len(share), 0.0
        for w in weights:
            joint = [a * b for a, b in zip(w, share)]
            mass = sum(joint)
            total += math.log(mass)
            gained = [g + j / mass for g, j in zip(gained, joint)]
        share = [g / len(weights) for g in gained]
    return share, total


def plain(text, model):
    """The chosen set with its shares, by word likelihoods under each language."""
    words = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()).split()
    weights = []
    for w in words:
        framed, logs = b" " + w + b" ", [0.0] * len(model.languages)
        for k in range(len(w)):
            a, b, c = framed[k : k + 3]
            bucket = (((a << 16 | b << 8 | c) * 2654435761) % (1 << 32)) >> 17
            logs = [s + float(x) for s, x in zip(logs, model.scores[bucket])]
        weights.append([math.exp(v - max(logs)) + op.FLOOR for v in logs])
    every, _ = steps(weights, [1 / len(model.languages)] * len(model.languages), op.STEPS)
    top = sorted(range(len(every)), key=lambda k: (-every[k], k))[: op.MOST_IN_SET]
    best = None
    for k in range(1, len(top) + 1):
        first = [max(every[i], 1e-9) for i in top[:k]]
        near = [[w[i] for i in top[:k]] for w in weights]
        shares, total = steps(near, [f / sum(first) for f in first], op.SET_STEPS if k > 1 else 1)
        score = 2 * total - op.PENALTY * (k - 1) * math.log(len(words) + 1)
        if best is None or score > best[0]:
            best = score, dict(zip([model.languages[i] for i in top[:k]], shares))
    return best[1]


def test_sets_and_shares_equal_plain_steps(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(say(rng, lang, 40)), lang) for i, lang in enumerate(list(PARTS) * 25)]
    for i in range(40):  # documents in two or three languages
        some = rng.sample(list(PARTS), 2 + i % 2)
        words = [w for lang in some for w in say(rng, lang, rng.randrange(5, 60))]
        rng.shuffle(words)
        rows.append((1000 + i, " ".join(words) + " 12.", None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = op.train(docs)
    assert model.languages == sorted(PARTS)
    got, sizes = {r["doc_id"]: r for r in op.predict_languages(docs, model).collect()}, set()
    for i, text, _ in rows:
        want = plain(text, model)
        found = {x.split(":")[0]: float(x.split(":")[1]) for x in got[i]["languages"].split(",")}
        sizes.add(len(found))
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 2e-3 for k in want)
        assert abs(got[i]["score"] - max(want.values())) < 1e-4 and abs(want[got[i]["lang_pred"]] - max(want.values())) < 1e-6
    assert sizes >= {1, 2}


def test_counts_are_of_training_rows_alone(spark):
    import zlib

    rng = random.Random(4)
    rows = [(i, " ".join(say(rng, "aa" if i % 2 else "bb", 30)), "aa" if i % 2 else "bb") for i in range(60)]
    model = op.train(spark.createDataFrame([*rows, (500, "aa bb", None), (501, None, "aa"), (502, "12 ½", "cc")], "doc_id long, text string, lang string"))
    counts = np.full((op.BUCKETS, 2), op.SMOOTHING)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for w in re.findall("[a-z]+", text):
                framed = b" " + w.encode() + b" "
                for k in range(len(w)):
                    a, b, c = framed[k : k + 3]
                    counts[(((a << 16 | b << 8 | c) * 2654435761) % (1 << 32)) >> 17, int(lang == "bb")] += 1
    assert model.languages == ["aa", "bb"]
    assert np.allclose(model.scores, np.log(counts / counts.sum(0)), atol=1e-5)
