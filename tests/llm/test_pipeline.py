"""The pipeline against what its stages promise."""

import corpus_pipeline
from vitalframe.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    import random

    rng = random.Random(1)
    parts = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["sch", "ung", "zei", "kt"]}
    say = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=4)) for _ in range(n))
    rows = [(i, say(lang, 80), lang, "s", 0) for i, lang in enumerate(["aa", "bb"] * 30)]
    twin = rows[0][1]
    rows += [(100, twin.upper(), "aa", "s", 0), (101, None, "aa", "s", 0), (102, "77 88", "bb", "s", 0), (103, rows[1][1] + " me@here.org", "bb", "s", 0)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs, seen = spark.read.parquet(path), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = set(range(60)) - {0}
    assert set(seen["language_id"]) == {*range(60), 100, 103}
    assert set(seen["exact_dedup"]) == {*clean, 100, 103}
    assert set(seen["near_dedup"]) == {*clean, 100}
    assert set(seen["packing"]) == set(seen["near_dedup"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["packing"])


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


LONG = "".join(f"wort{'abcdefgh'[i % 8]}{'ijklm'[i * i % 5]}{i % 97} " for i in range(20_000))


def odd(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows and columns with clashing names."""
    long = LONG
    rows = [(None, "eins zwei drei"), (None, "eins zwei drei"), (1, None), (1, "vier fünf a@b.co"), (1, "vier fünf a@b.co"), (2, ""), (3, long), (4, long + "ende"), (5, "½")]
    return spark.createDataFrame([(i, t, "de", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS spans", "1 AS score", "2 AS node", "'k' AS kept")


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, ""), stage(spark, docs.limit(0), "")
        assert none.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"] if name != "packing" else None) for r in out.collect()), key=str)
        ids = sorted((i for i, _ in got), key=str)
        texts = {t for _, t in got}
        if name == "language_id":
            assert ids == [1, 1, 3, 4, None, None]
        elif name == "exact_dedup":
            assert len(got) == 6 and len(texts - {None, ""}) == 5  # null counts as empty
        elif name == "near_dedup":
            assert LONG in texts and LONG + "ende" not in texts and len(got) == 8
        elif name == "personal_data":
            assert len(got) == 9 and sum(t == "vier fünf [EMAIL]" for _, t in got) == 2
        else:
            assert set(ids) == {None, 1, 2, 3, 4, 5}


def test_language_stage_without_labels(spark):
    docs = odd(spark).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 6
