"""Text quality by a sparse ensemble of rules.

Shallow trees are grown on statistics of labelled texts; every path from a root to a node is a rule,
a conjunction of bounds on statistics. A logistic regression with lasso penalty weighs the rules and
drops most of them. What stays is compiled into one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.llm import text as tx
from cargolens.llm.common import give_back_memory
from cargolens.llm.labelled import fresh_name, held_out, labelled_texts, training_labels
from cargolens.plans.staging import stage

STATISTICS = (
    "words",
    "word_length",
    "distinct_pairs",
    "doubled_words",
    "lines",
    "repeated_lines",
    "words_a_line",
    "letters",
    "capitals",
    "digits",
    "stops",
    "exclamations",
    "bars",
    "symbols",
    "symbol_words",
    "capital_words",
    "long_words",
)
TREES, DEPTH, LASSO = 24, 4, 0.0005

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_STOP = tx.byte_table(b".,;:?'\"-()")
_SYMBOL = tx.NOT_SPACE & ~_LETTER & ~_DIGIT & ~_STOP


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How many different hashes each text has."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[fresh], minlength=texts)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; counts as shares, sizes as log(1 + n).

    Texts without words have zeros, and 1 for ``distinct_pairs``, as others of one word have.
    """
    buf, offsets = tx.utf8(texts)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    starts, ends, owner = tx.runs(buf, offsets, tx.NOT_SPACE)
    words = np.bincount(owner, minlength=n)
    size = np.maximum(_sums(tx.NOT_SPACE[buf], offsets), 1)
    per_word = np.maximum(words, 1)
    line_starts, line_ends, line_owner = tx.runs(buf, offsets, _BYTES != 10)
    lines = np.bincount(line_owner, minlength=n)
    per_line = np.maximum(lines, 1)
    letters = _sums(_LETTER[buf], offsets)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    in_word = lambda flags: np.bincount(owner[flags], minlength=n) / per_word
    hashes = tx.word_hashes(buf, starts, ends)
    pair_hashes = tx.window_hashes(hashes, 2)
    inside = owner[: len(pair_hashes)] == owner[1:]
    pair_hashes, pair_owner = pair_hashes[inside], owner[1:][inside]
    doubled = (hashes[1:] == hashes[:-1])[inside]
    pairs = np.bincount(pair_owner, minlength=n)
    columns = (
        np.log1p(words),
        np.bincount(owner, ends - starts, minlength=n) / per_word,
        np.where(pairs > 0, _distinct(pair_hashes, pair_owner, n) / np.maximum(pairs, 1), 1),
        np.bincount(pair_owner[doubled], minlength=n) / per_word,
        np.log1p(lines),
        1 - _distinct(tx.word_hashes(buf, line_starts, line_ends), line_owner, n) / per_line,
        np.log1p(words / per_line),
        letters / size,
        _sums(_UPPER[buf], offsets) / np.maximum(letters, 1),
        _sums(_DIGIT[buf], offsets) / size,
        _sums(_STOP[buf], offsets) / size,
        _sums(buf == ord("!"), offsets) / size,
        _sums(buf == ord("|"), offsets) / size,
        _sums(_SYMBOL[buf], offsets) / size,
        in_word(symbols[ends] > symbols[starts]),
        in_word((upper[ends] - upper[starts] > 1)),
        in_word(ends - starts > 24),
    )
    for k, c in enumerate(columns):
        out[:, k] = c
    lone = STATISTICS.index("repeated_lines")
    out[:, lone] = np.where(lines > 0, out[:, lone], 0)
    return out


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """All columns of ``docs`` and its statistics as an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in tx.slices(batches, "text"):
            found = statistics(batch.column("text"))
            at = np.arange(len(found) + 1) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, tx.list_column(found.ravel(), at, pa.float64())],
                names=[*batch.schema.names, name],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, schema)


Rule = tuple[tuple[int, float, float], ...]  # (statistic, over, up to), each statistic once


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; without any, the score is the share of label 1 in the training rows."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, statistics: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(compiled(rule, statistics), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def text(self) -> list[str]:
        """The rules as people read them."""
        return [
            f"{weight:+.3f} if "
            + " and ".join(f"{low:.4g} < {STATISTICS[k]} <= {high:.4g}" for k, low, high in rule)
            for rule, weight in self.rules
        ]


def compiled(rule: Rule, statistics: Column) -> Column:
    """A rule as a boolean column."""
    test = F.lit(True)
    for k, low, high in rule:
        if low > -np.inf:
            test = test & (statistics[k] > low)
        if high < np.inf:
            test = test & (statistics[k] <= high)
    return test


def tree_rules(model) -> list[Rule]:
    """The paths to all nodes below the roots of a forest's trees, each rule once."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[int, tuple[float, float]]) -> None:
        if bounds:
            found[tuple((k, *b) for k, b in sorted(bounds.items()))] = None
        if node.getClass().getSimpleName() != "InternalNode":
            return
        k, t = node.split().featureIndex(), float(node.split().threshold())
        low, high = bounds.get(k, (-np.inf, np.inf))
        walk(node.leftChild(), bounds | {k: (low, min(high, t))})
        walk(node.rightChild(), bounds | {k: (max(low, t), high)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(training: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """A model from rows (label, statistics); the rows are bounded by the caller."""
    rows = stage(training.select("label", array_to_vector("statistics").alias("x"), "statistics"), "training")
    ends = rows.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if ends[0] is None or ends[0] == ends[1]:
        share = 0.5 if ends[0] is None else min(max(ends[2], 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), ())
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7,
        featureSubsetStrategy="onethird", minInstancesPerNode=3,
    ).fit(rows)
    rules = tree_rules(forest)
    if not rules:
        return RuleModel(float(np.log(ends[2] / (1 - ends[2]))), ())
    held = F.array(*(compiled(r, F.col("statistics")).cast("double") for r in rules))
    # which rule comes first makes no difference: the lasso sees them all
    weighed = stage(rows.select("label", held.alias("held")), "rules").select(
        "label", array_to_vector("held").alias("x")
    )
    found = LogisticRegression(
        featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso,
        standardization=False, maxIter=60,
    ).fit(weighed.coalesce(4))
    weights = found.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(rules, weights) if w)
    return RuleModel(float(found.intercept), kept)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> RuleModel:
    """The rule model for ``labels.quality`` from a bounded sample outside the held-out fold."""
    sample = training_labels(labels, "quality", folds, fold)
    return fit(with_statistics(labelled_texts(docs, sample), "statistics"))


def scored(docs: DataFrame, model: RuleModel, score: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score from 0 to 1: higher, the likelier good text."""
    name = fresh_name(docs, "_statistics")
    rows = with_statistics(docs, name)
    return rows.withColumn(score, model.score(F.col(name))).drop(name)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Only text gives the score. Null and empty texts are scored as texts without words; a null doc_id
    is scored and not held out; repeated rows stay. Without labels of both kinds every score is the
    same.
    """
    narrow = docs.select("doc_id", "text")
    rows = scored(narrow, train(narrow, labels, folds, fold))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id"), folds, fold).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with the same columns."""
    score = fresh_name(docs, "_score")
    rows = scored(docs, train(docs, labels), score)
    return rows.filter(F.col(score) >= 0.5).drop(score)
