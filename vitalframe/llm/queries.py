"""The registered query of each corpus operator, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalframe.llm import bpe, decontaminate, exact_dedup, langid, media, packing, pii, resampling, sharding, simhash, substring, token_counts, whitening
from vitalframe.llm.common import documents_of


def tokenizer_path(name: str) -> str:
    """A public vocabulary file, found where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents_of(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op2_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents_of(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents_of(spark, sf_dir), shingle=3, most_bits=2)


def op4_cover_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents_of(spark, sf_dir), window=35)


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents_of(spark, sf_dir), shards=16)


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(documents_of(spark, sf_dir))


def op7_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents_of(spark, sf_dir))


def op8_patricia_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_documents(documents_of(spark, sf_dir))


OP8_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents_of(spark, sf_dir))


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents_of(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op11_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     known AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
               FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT size FROM known),
     placed AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS words FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
     hits AS (SELECT r, i, size, item_id FROM placed JOIN known USING (size, words)),
     covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(k) GROUP BY r),
     items AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def op12_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample_documents(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), longest=1, buckets=10_000, least_words=20, percent=10, seed=2024)


# CRC-32 by a table of 256 entries; the words' bytes come from their hexadecimal form.
OP13_SQL = f"""
WITH steps AS (SELECT list(list_reduce([v] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY v) AS t FROM range(256) AS x(v)),
     d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
     b AS (SELECT {_WORDS} AS w FROM benchmark),
     each AS (SELECT DISTINCT unnest(w) AS word FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
     hashed AS (SELECT word, xor(4294967295, list_reduce([4294967295] || list_transform(range(octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::BIGINT), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) % 10000 AS bucket FROM each, steps),
     words AS (SELECT r, bucket FROM (SELECT r, unnest(w) AS word FROM d) JOIN hashed USING (word)),
     corpus AS (SELECT bucket, count(*) AS s FROM words GROUP BY bucket),
     target AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM b) JOIN hashed USING (word) GROUP BY bucket),
     totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t),
     gain AS (SELECT bucket, floor(1000 * ln(((coalesce(target.t, 0) + 1)::DOUBLE * (totals.s + 10000)) / ((corpus.s + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS g FROM corpus LEFT JOIN target USING (bucket), totals),
     weights AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN gain USING (bucket) GROUP BY r),
     scored AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(d.doc_id::VARCHAR, 'null'))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weights USING (r)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_trie_token_counts": op1_trie_token_counts,
        "op2_swap_packing": op2_swap_packing,
        "op3_golay_simhash": op3_golay_simhash,
        "op4_cover_substring_dedup": op4_cover_substring_dedup,
        "op5_jump_sharding": op5_jump_sharding,
        "op6_jpeg_media": op6_jpeg_media,
        "op7_mixture_langid": op7_mixture_langid,
        "op8_patricia_dedup": op8_patricia_dedup,
        "op9_weak_pii": op9_weak_pii,
        "op10_prefix_bpe": op10_prefix_bpe,
        "op11_winnow_decontamination": op11_winnow_decontamination,
        "op12_compensated_whitening": op12_compensated_whitening,
        "op13_crc_resampling": op13_crc_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_patricia_dedup": OP8_SQL, "op11_winnow_decontamination": OP11_SQL, "op13_crc_resampling": OP13_SQL}
