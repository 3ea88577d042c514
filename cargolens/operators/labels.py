"""Risk labels from rules and from free-form label columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.constants import (
    EPSILON,
    HISTORY_RISK_COUNTRIES,
    HISTORY_RISK_STATUSES,
    NEGATIVE_LABEL_PARTS,
    NEGATIVE_LABELS,
    POSITIVE_LABEL_PARTS,
    POSITIVE_LABELS,
    SAMPLE_RISK_COUNTRIES,
)
from cargolens.functions.columns import col, draw60, to_double
from cargolens.operators.selection import lowest_share


def _any(*conditions: Column) -> Column:
    """1 when any condition holds; an unknown condition counts as false."""
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions]).cast("int")


def label_history(df: DataFrame, label: str = "is_risky") -> DataFrame:
    """Rules for historical tables: origin, weight gap, dwell, status, value (L1)."""
    declared = col("Declared_Weight")
    gap_pct = F.abs(col("Measured_Weight") - declared) / (declared + EPSILON) * 100
    rules = [
        col("Origin_Country").isin(HISTORY_RISK_COUNTRIES),
        gap_pct > 50,
        col("Dwell_Time_Hours") > 100,
        col("Declared_Value") > 100000,
    ]
    if "Clearance_Status" in df.columns:
        rules.append(col("Clearance_Status").isin(HISTORY_RISK_STATUSES))
    return df.withColumn(label, _any(*rules))


def label_sample(df: DataFrame, label: str = "is_risky") -> DataFrame:
    """Rules used with sample data: origin, absolute weight gap, value density (L2)."""
    density = col("Declared_Value") / (col("Declared_Weight") + EPSILON)
    return df.withColumn(
        label,
        _any(
            col("Origin_Country").isin(SAMPLE_RISK_COUNTRIES),
            F.abs(col("Measured_Weight") - col("Declared_Weight")) > 200,
            density > 5000,
            density < 10,
        ),
    )


def label_fallback(df: DataFrame, label: str = "is_risky") -> DataFrame:
    """Labels from features when a table brings none (L3)."""
    return df.withColumn(
        label,
        _any(
            col("flag_weight_mismatch") == 1,
            col("flag_high_value_density") == 1,
            col("origin_country_risk") > 1,
        ),
    )


def label_retrain(df: DataFrame, label: str = "is_risky") -> DataFrame:
    """Rules meant for retraining, on the feature table (L4)."""
    return df.withColumn(
        label,
        _any(
            F.abs(col("weight_diff_pct")) > 20,
            col("flag_high_value_density") == 1,
            col("origin_country_risk") == 2,
            col("dest_country_risk") == 2,
            col("flag_excessive_dwell") == 1,
        ),
    )


def normalized_label(c: str | Column, kind: T.DataType | None = None) -> Column:
    """0, 1 or NULL from a boolean, a number, also one in text, or one of many words."""
    value = col(c)
    if isinstance(kind, T.BooleanType):
        return value.cast("int")
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(value.cast("double")), (value > 0).cast("int"))
    text = F.lower(F.trim(value.cast("string")))
    number = text.try_cast("double")

    def holds(parts: list[str]) -> Column:
        return reduce(or_, [text.contains(p) for p in parts])

    return (
        F.when(number.isNotNull() & ~F.isnan(number), (number > 0).cast("int"))
        .when(text.isin(POSITIVE_LABELS), 1)
        .when(text.isin(NEGATIVE_LABELS), 0)
        .when(holds(POSITIVE_LABEL_PARTS), 1)
        .when(holds(NEGATIVE_LABEL_PARTS), 0)
    )


def normalize_labels(df: DataFrame, source: str, label: str = "label") -> DataFrame:
    """Add the normalised form of a label column, using its declared type."""
    return df.withColumn(label, normalized_label(source, df.schema[source].dataType))


def numeric_labels(df: DataFrame, source: str, label: str = "label") -> DataFrame:
    """Whole-number labels; anything else counts 0."""
    return df.withColumn(label, F.coalesce(to_double(source).try_cast("bigint"), F.lit(0)))


def label_distribution(df: DataFrame, label: str = "is_risky") -> DataFrame:
    """Rows per label value."""
    return df.groupBy(col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def guard_single_class(
    df: DataFrame, label: str, id_col: str = "Container_ID", share: float = 0.1, seed: int = 42
) -> DataFrame:
    """Flip a repeatable tenth of the labels, opt-in and only when one class is present.

    The rows with the lowest draws are flipped; the cut is found by exact selection, so no
    sort of the table takes place.
    """
    bounds = df.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    if bounds["low"] != bounds["high"]:
        return df
    draw = draw60(id_col, seed)
    cut = lowest_share(df, draw, share)
    return df.withColumn(label, F.when(draw <= F.lit(cut), 1 - col(label)).otherwise(col(label)))
