"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on; chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Is crc32(doc_id as text) mod ``folds`` equal to ``fold``; false for null."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(part == fold, F.lit(False))


def training_labels(
    labels: DataFrame, column: str, folds: int, fold: int, most: int = SAMPLE_ROWS
) -> DataFrame:
    """(doc_id, label 0.0 or 1.0) of at most ``most`` documents outside the held-out fold.

    Null ids and labels are left out; of several labels of one document the smallest counts.
    """
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.filter(~held_out(F.col("doc_id"), folds, fold))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min((F.col(column) > 0).cast("double")).alias("label")
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``sample`` (doc_id and more) with a ``text``: one row a document, that of the smallest text hash.

    Rows that repeat a doc_id are cut to one before the shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    return rows.groupBy(*sample.columns).agg(first.alias("t")).select(*sample.columns, "t.text")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
