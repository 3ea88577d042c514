"""From raw documents to packed training rows, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; what it
returns is written as Parquet and read again as the next one's ``docs``. All stages but the last
return the columns of ``documents``; where a text changes, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import minhash, packing, pii, quality, suffixes
from cargolens.llm.common import table
from cargolens.llm.labelled import fresh_name
from cargolens.plans.staging import stage

#: SQL cannot fit a classifier, so the rows are tested against a plain version instead.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as long as its texts."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies (five words, 0.8).

    Rows that repeat a doc_id are one document and stay together.
    """
    classes = minhash.near_duplicates(docs, width=5, percent=80)
    name = fresh_name(docs, "_gone")
    gone = classes.filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they occur first; texts that consist of repeats go."""
    return _measured(suffixes.without_repeats(docs))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    return _measured(pii.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicate removal", drop_near_copies),
    ("repeated passages", cut_repeated_passages),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
