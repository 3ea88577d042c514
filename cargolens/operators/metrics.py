"""Evaluation of scores and predictions against labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.columns import col
from cargolens.operators.ordering import PART, ordered_parts, running_sums
from cargolens.plans.staging import stage


def cross_entropy(
    df: DataFrame,
    label: str = "label",
    probability: str = "probability",
    weights: Sequence[float] = (),
    regularization: float = 0.0,
) -> DataFrame:
    """Mean binary cross-entropy plus the L2 term of the given weights (M7)."""
    y, p = col(label).cast("double"), col(probability)
    loss = y * F.log(p + 1e-15) + (1 - y) * F.log(1 - p + 1e-15)
    penalty = F.lit(regularization * sum(w * w for w in weights) / 2) / F.count(F.lit(1))
    return df.agg((-F.avg(loss) + penalty).alias("loss"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def _cells(label: str, predicted: str) -> list[Column]:
    y, p = col(label), col(predicted)
    return [
        F.count_if((y == 0) & (p == 0)).alias("true_negative"),
        F.count_if((y == 0) & (p == 1)).alias("false_positive"),
        F.count_if((y == 1) & (p == 0)).alias("false_negative"),
        F.count_if((y == 1) & (p == 1)).alias("true_positive"),
    ]


def binary_metrics(
    df: DataFrame, label: str = "label", predicted: str = "prediction"
) -> DataFrame:
    """Accuracy, precision, recall, F1 and the four cells from one aggregate."""
    tn, fp, fn, tp = map(col, ["true_negative", "false_positive", "false_negative", "true_positive"])
    return df.agg(*_cells(label, predicted)).select(
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        tn, fp, fn, tp,
    )


def class_report(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class with both averages."""
    tn, fp, fn, tp = map(col, ["true_negative", "false_positive", "false_negative", "true_positive"])

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"),
            _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1_score"),
            (hit + missed).alias("support"),
        )

    def mean(name: str, weighted: bool) -> Column:
        zero, one = col("zero"), col("one")
        total = zero["support"] + one["support"]

        def of(field: str) -> Column:
            if weighted:
                return _ratio(
                    zero[field] * zero["support"] + one[field] * one["support"], total
                ).alias(field)
            return ((zero[field] + one[field]) / 2).alias(field)

        return F.struct(
            F.lit(name).alias("class"),
            *[of(f) for f in ("precision", "recall", "f1_score")],
            total.alias("support"),
        )

    classes = df.agg(*_cells(label, predicted)).select(
        line("0", tn, fn, fp).alias("zero"), line("1", tp, fp, fn).alias("one")
    )
    rows = F.array(col("zero"), col("one"), mean("macro avg", False), mean("weighted avg", True))
    return classes.select(F.inline(rows))


def roc_auc(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    *,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Exact area under the ROC curve by rank sum, ties averaged; NaN for one class.

    Rows shrink to one per distinct score by a partial aggregate; the running count of negatives
    over the ordered scores is computed range by range.
    """
    y = col(label)
    scores = df.groupBy(col(score).alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    order = [F.asc("s")]
    parts = ordered_parts(scores, order, staging=staging)
    ranked = running_sums(parts, order, {"neg_upto": col("neg")})
    wins = F.sum(col("pos") * (col("neg_upto") - col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.drop(PART).agg(
        F.coalesce(F.try_divide(wins, pairs), F.lit(float("nan"))).alias("roc_auc")
    )


def predict_at(df: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    """1 where the score reaches the threshold, which must lie within [0, 1]."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    return df.withColumn("prediction", (col(score) >= threshold).cast("int"))


def label_row_counts(raw: DataFrame, cleaned: DataFrame, label: str = "label") -> DataFrame:
    """Rows in total, with and without a readable label, and after cleaning."""
    return raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(label).alias("rows_with_valid_labels"),
        F.count_if(col(label).isNull()).alias("rows_without_valid_labels"),
    ).withColumn("rows_after_cleaning", cleaned.agg(F.count(F.lit(1))).scalar())


def evaluation_report(
    raw: DataFrame,
    scored: DataFrame,
    *,
    label: str = "label",
    threshold: float = 0.5,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """One nested row with row counts, metrics and the confusion matrix.

    ``raw`` holds all input rows with the normalised label; ``scored`` the rows that were scored.
    """
    judged = predict_at(scored, threshold)
    cells = ["true_negative", "false_positive", "false_negative", "true_positive"]
    counts = label_row_counts(raw, scored, label)
    found = binary_metrics(judged, label).select(
        F.struct(
            "accuracy", "precision", "recall", "f1_score", F.struct(*cells).alias("confusion_matrix")
        )
    )
    auc = roc_auc(scored, label, staging=staging)
    return counts.withColumns({"_m": found.scalar(), "roc_auc": auc.scalar()}).select(
        *counts.columns,
        F.lit(threshold).alias("threshold"),
        "_m.accuracy", "_m.precision", "_m.recall", "_m.f1_score", "roc_auc",
        "_m.confusion_matrix",
    )


def evaluation_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Row-level evaluation table (M15) from rows with score, level and prediction."""
    return df.select(
        col("Container_ID").cast("string").alias("container_id"),
        col(label).cast("int").alias("actual_label"),
        col("prediction").alias("predicted_label"),
        F.bround(col("score") * 100, 4).alias("risk_score"),
        "risk_level",
        F.bround("classifier_score", 6).alias("classifier_score"),
        F.bround("anomaly_score", 6).alias("anomaly_score"),
        (col(label) == col("prediction")).cast("int").alias("is_correct"),
    )
