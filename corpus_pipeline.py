"""The training-data pipeline over documents: language ID, exact dedup, near-dedup, personal data, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents. run() applies the
stages to the documents table of a folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm import exact_dedup, langid, packing, pii, queries, simhash
from vitalframe.llm.common import documents_of, remove_folder, shared_folder, written

#: A document goes whose set of languages has a smaller share of its mixture.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no set of languages fits; the models are learned from the stage's own input."""
    return langid.keep_identified(docs, langid.train(docs), LEAST_SHARE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z, keep the row with the largest doc_id."""
    return exact_dedup.keep_owners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of groups linked by a Jaccard similarity of 0.8 or more over five-word shingles, keep the row with the smallest doc_id."""
    return simhash.keep_first(docs, shingle=5)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the text by the kind of each span; n_chars follows the new text."""
    masked = pii.mask_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", mask_private),
    ("packing", pack),
]

#: Mixtures, fingerprints and trained span classifiers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every stage's rows are written before the next one reads them, and removed after it wrote its own."""
    docs, folder, before = documents_of(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
