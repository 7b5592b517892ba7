"""Documents that every corpus operator must survive."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASH = ("piece", "shard", "key", "print", "_text", "_group", "text_sha256", "keep_id", "kept", "fingerprint", "spans", "score", "copies", "at", "length")


def words(rng, n, vocabulary=400):
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(40)]
    long = words(rng, 30_000)
    passage = words(rng, 60)
    made = [
        None, "", " \t\n", "123 456", "a", "É", "Straße ist groß", "A b C", "a b c", "a  b c", *base, base[3], base[3].upper(), base[4], base[4], long,
        base[5] + " " + passage + " " + base[6], passage + " " + base[7], passage, base[8] + " " + base[8], long[:4000] + " x", "中文 字 符", "x" * 5000, "́ é", "<|endoftext|> z",
    ]
    return made


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids in another order than the rows, one null id, one row repeated, and columns with clashing names."""
    rows = [((i * 37) % len(texts), t, "de" if i % 3 else "en", f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows[11] = (None, *rows[11][1:])
    rows.append(rows[20])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH]).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
