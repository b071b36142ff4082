"""The corpus pipeline: stages over ``documents``, each written before the next reads it.

Every stage takes ``(spark, docs, sf_dir)``. The first four return the columns
of ``documents`` and only drop rows; the last returns token ids. Nothing here is
expressible in SQL (trained models, fingerprints, a tokenizer), so there is no
oracle and the tests compare with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coverset.llm import decontaminate, quality, sentencepiece, simhash, toxicity
from coverset.llm.common import table
from coverset.llm.queries import tokenizer_path
from coverset.session import attach, materialise

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity 0.8; of each group the smallest id stays."""
    attach(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    attach(spark)
    return sentencepiece.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
