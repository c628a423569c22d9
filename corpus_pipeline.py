"""Corpus pipeline: stages over ``documents``, each written and read again.

1. toxicity: rows that the subsequence-kernel SVM rejects go.
2. exact_dedup: of equal texts the row of the smallest doc_id stays.
3. near_dedup: of each class of the chosen-path Jaccard join one document stays.
4. pii: personal data is replaced by its kind; every document stays.
5. packing: all documents are packed into sequences of 4096 tokens.

Stages 1 to 4 return the columns of their input. Each is fitted, where it has a model,
on the tables of ``sf_dir`` or on its own input, and works on every row it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from purselake.llm import exact_dedup as exact
from purselake.llm import jaccard_join, packing, pii, toxicity
from purselake.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.score_documents(boxed, toxicity.fitted(spark, sf_dir)).filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_class(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, pii.fitted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: A kernel machine, a random tree and a field have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
