"""From classifier and anomaly scores to a risk score, level and prediction row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.constants import (
    ANOMALY_WEIGHT,
    CLASSIFIER_WEIGHT,
    CRITICAL_FROM,
    HIGH_FROM,
    MEDIUM_FROM,
)
from cargolens.functions.columns import col
from cargolens.operators.explain import explanation
from cargolens.schema import PREDICTION_COLUMNS


def blend_weights(
    classifier: float = CLASSIFIER_WEIGHT, anomaly: float = ANOMALY_WEIGHT
) -> tuple[float, float]:
    """Weights that sum to one; negative or all-zero weights are rejected."""
    if classifier < 0 or anomaly < 0:
        raise ValueError("weights must not be negative")
    if classifier + anomaly == 0:
        raise ValueError("one weight must be above 0")
    return classifier / (classifier + anomaly), anomaly / (classifier + anomaly)


def risk_score(
    classifier: Column, anomaly: Column, weights: tuple[float, float] | None = None
) -> Column:
    """Weighted mean of both scores within [0, 1]."""
    cw, aw = blend_weights(*(weights or (CLASSIFIER_WEIGHT, ANOMALY_WEIGHT)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cw * classifier + aw * anomaly))


def risk_level(score: Column) -> Column:
    """Level of a score in [0, 1]; a limit belongs to the upper level (R2)."""
    return (
        F.when(score >= CRITICAL_FROM, "Critical")
        .when(score >= HIGH_FROM, "High")
        .when(score >= MEDIUM_FROM, "Medium")
        .otherwise("Low")
    )


def score_rows(
    df: DataFrame,
    weights: tuple[float, float] | None = None,
    classifier: str = "classifier_score",
    anomaly: str = "anomaly_score",
) -> DataFrame:
    """Add ``score`` in [0, 1] and ``risk_level``."""
    return df.withColumn("score", risk_score(col(classifier), col(anomaly), weights)).withColumn(
        "risk_level", risk_level(col("score"))
    )


def to_predictions(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prediction rows from scored feature rows.

    A row without id is named after its place in the input when ``ingest_seq`` is known.
    """
    container = col("Container_ID").cast("string")
    if "ingest_seq" in df.columns:
        container = F.coalesce(container, F.concat(F.lit("C"), col("ingest_seq").cast("string")))
    fields = {
        "container_id": container,
        "risk_score": col("score") * 100,
        "risk_level": col("risk_level"),
        "explanation_summary": explanation(),
        "confidence": F.greatest(col("classifier_score"), col("anomaly_score")),
        "classifier_score": col("classifier_score"),
        "anomaly_score": col("anomaly_score"),
    }
    return df.select(*[fields[c].alias(c) for c in PREDICTION_COLUMNS], *map(col, keep))
