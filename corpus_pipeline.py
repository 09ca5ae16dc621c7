"""The corpus pipeline: documents, less toxic ones and near copies, masked, mixed to target weights, packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of documents; a column that some operator adds
inside a stage never meets one of docs by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import mixing, packing, pii, simhash, toxicity
from keyloom.llm.common import bounded, remove, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose worst window scores below one half. Null and empty texts are judged like an empty window.

    Very long texts are scored whole; rows that repeat fare alike; without labels of both classes all rows stay.
    """
    bounded(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies: 0.8 or more of their five-word shingles in common.

    Rows whose text has no words, null or empty, are left as they are: nothing in them is a copy of a text. Of equal doc_ids, or where
    all are null, the first row stays.
    """
    bounded(spark)
    return simhash.representatives(docs, width=5, similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts with personal data masked by <kind>, n_chars renewed for the texts that changed. Null texts stay null."""
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows sampled with the probabilities that rake token weights to the targets of sources, languages and topics.

    Rows without tokens, null and empty texts, are never drawn; null sources and languages are levels of their own; rows of one
    doc_id, or of none, share a draw.
    """
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences; a null or empty text is one piece of one id."""
    bounded(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained network and byte-level tokens are not SQL; tests compare each stage, and all in turn, with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet to the shared folder and read again.

    A stage's rows are deleted once the next one is written, and the last ones when the application ends.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
