"""The 32 model features and their helper columns.

Row-wise features are plain column expressions added in a few blocks, which Catalyst folds into
one projection. Table-wide statistics come from a ``Profile``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.constants import (
    ENCODED_CATEGORIES,
    EPSILON,
    FEATURES,
    HIGH_RISK_COUNTRIES,
    HIGH_RISK_HS,
    MEDIUM_RISK_COUNTRIES,
    MEDIUM_RISK_HS,
)
from cargolens.functions.columns import col, flag, hour_of, in_classes, to_double
from cargolens.operators.profile import ROUTE, Profile, fit_profile
from cargolens.plans.staging import stage
from cargolens.schema import SchemaError


def weight_measures(df: DataFrame) -> DataFrame:
    """Weight differences, ratio and logarithm."""
    declared = F.coalesce(to_double("Declared_Weight"), F.lit(1.0))
    df = df.withColumns(
        {
            "Declared_Weight": declared,
            "Measured_Weight": F.coalesce(to_double("Measured_Weight"), declared),
        }
    )
    declared, measured = col("Declared_Weight"), col("Measured_Weight")
    gap = measured - declared
    return df.withColumns(
        {
            "weight_diff": gap,
            "weight_diff_abs": F.abs(gap),
            "weight_diff_pct": gap / (declared + EPSILON) * 100,
            "weight_ratio": measured / (declared + EPSILON),
            "log_weight": F.log1p(declared),
            "flag_zero_declared_weight": flag(declared <= 0),
        }
    )


def value_measures(df: DataFrame) -> DataFrame:
    """Value density and logarithm."""
    df = df.withColumns(
        {
            "Declared_Value": F.coalesce(to_double("Declared_Value"), F.lit(0.0)),
            "Declared_Weight": F.coalesce(to_double("Declared_Weight"), F.lit(1.0)),
        }
    )
    density = col("Declared_Value") / (col("Declared_Weight") + EPSILON)
    return df.withColumns(
        {
            "value_per_kg": density,
            "log_value": F.log1p(col("Declared_Value")),
            "value_to_weight_ratio": density,
            "flag_zero_declared_value": flag(col("Declared_Value") <= 0),
        }
    )


def dwell_measures(df: DataFrame) -> DataFrame:
    """Dwell logarithm and the short-stay flag."""
    dwell = F.coalesce(to_double("Dwell_Time_Hours"), F.lit(24.0))
    return df.withColumns({"Dwell_Time_Hours": dwell}).withColumns(
        {
            "dwell_time_log": F.log1p(col("Dwell_Time_Hours")),
            "flag_minimal_dwell": flag(col("Dwell_Time_Hours") < 2),
        }
    )


def with_measures(df: DataFrame) -> DataFrame:
    """All row-wise inputs of the profile."""
    return dwell_measures(value_measures(weight_measures(df)))


def _above(name: str, limit: float | None):
    return F.lit(0) if limit is None else flag(col(name) > limit)


def weight_features(df: DataFrame, profile: Profile) -> DataFrame:
    """F1-F7."""
    df = weight_measures(df)
    return df.withColumn(
        "flag_weight_mismatch", _above("weight_diff_abs", profile.upper("weight", 2))
    )


def value_features(df: DataFrame, profile: Profile) -> DataFrame:
    """F8-F13."""
    low = profile.upper("density", -1.5)
    return value_measures(df).withColumns(
        {
            "flag_high_value_density": _above("value_per_kg", profile.upper("density", 2)),
            "flag_low_value_density": F.lit(0)
            if low is None
            else flag((col("value_per_kg") < low) & (col("value_per_kg") > 0)),
        }
    )


def country_features(df: DataFrame) -> DataFrame:
    """Country risk and its sum."""
    risk = {
        name: in_classes(F.upper(col(source)), HIGH_RISK_COUNTRIES, MEDIUM_RISK_COUNTRIES)
        for name, source in (
            ("origin_country_risk", "Origin_Country"),
            ("dest_country_risk", "Destination_Country"),
        )
    }
    total = risk["origin_country_risk"] + risk["dest_country_risk"]
    return df.withColumns(
        {**risk, "route_risk_total": total, "flag_high_risk_route": flag(total >= 3)}
    )


def route_features(df: DataFrame, profile: Profile) -> DataFrame:
    """F14-F19; the number of rows per route is looked up in the profile."""
    df = country_features(df).join(profile.lookup("route"), ROUTE, "left")
    often = F.coalesce(col("route_rows"), F.lit(1)).cast("bigint")
    return df.withColumns(
        {"route_frequency": often, "route_frequency_log": F.log1p(often.cast("double"))}
    ).drop("route_rows")


def hs_features(df: DataFrame) -> DataFrame:
    """F20-F21."""
    code = col("HS_Code").cast("string")
    return df.withColumns(
        {
            "hs_code_risk": in_classes(F.substring(code, 1, 2), HIGH_RISK_HS, MEDIUM_RISK_HS),
            "hs_code_first_digit": F.substring(F.coalesce(code, F.lit("nan")), 1, 1),
        }
    )


def time_features(df: DataFrame) -> DataFrame:
    """F22-F29; constants stand in for a date or time column that is absent."""
    if "Declaration_Date" in df.columns:
        date = col("Declaration_Date").try_cast("date")
        calendar = {
            "day_of_week": F.weekday(date),
            "month": F.month(date),
            "day_of_month": F.dayofmonth(date),
            "is_weekend": flag(F.weekday(date) >= 5),
            "is_month_end": flag(F.dayofmonth(date) >= 25),
        }
    else:
        calendar = {
            "day_of_week": F.lit(0),
            "month": F.lit(1),
            "day_of_month": F.lit(1),
            "is_weekend": F.lit(0),
            "is_month_end": F.lit(0),
        }
    hour = hour_of("Declaration_Time") if "Declaration_Time" in df.columns else F.lit(12)
    return df.withColumns({**calendar, "hour_of_day": hour}).withColumns(
        {
            "is_night": flag((col("hour_of_day") < 6) | (col("hour_of_day") >= 22)),
            "is_business_hours": flag(col("hour_of_day").between(9, 17)),
        }
    )


def dwell_features(df: DataFrame, profile: Profile) -> DataFrame:
    """F30-F32."""
    return dwell_measures(df).withColumn(
        "flag_excessive_dwell", _above("Dwell_Time_Hours", profile.upper("dwell", 1.5))
    )


def category_features(df: DataFrame, profile: Profile) -> DataFrame:
    """Rows per category as a number, 0 for an unseen one."""
    for name in ENCODED_CATEGORIES:
        if name in df.columns and name in profile.categories:
            rows = f"{name}_rows"
            df = (
                df.join(profile.lookup(name), name, "left")
                .withColumn(f"{name}_encoded", F.coalesce(col(rows), F.lit(0)).cast("bigint"))
                .drop(rows)
            )
    return df


_NEEDED = [
    "Declared_Weight", "Measured_Weight", "Declared_Value", "Origin_Country",
    "Destination_Country", "Destination_Port", "HS_Code", "Dwell_Time_Hours",
]


def engineer_features(
    df: DataFrame,
    profile: Profile | None = None,
    *,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """All features (F36). Without a profile, the statistics of ``df`` itself are fitted first."""
    absent = [c for c in _NEEDED if c not in df.columns]
    if absent:
        raise SchemaError(f"Columns needed for features are missing: {absent}")
    if profile is None:
        profile = fit_profile(with_measures(df), staging=staging)
    df = weight_features(df, profile)
    df = value_features(df, profile)
    df = route_features(df, profile)
    df = hs_features(df)
    df = time_features(df)
    df = dwell_features(df, profile)
    return category_features(df, profile)


def available_features(df: DataFrame) -> list[str]:
    """Model features that the table has, in model order."""
    return [c for c in FEATURES if c in df.columns]
