"""Plain-text explanations as one projection of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens import constants as K
from cargolens.functions.columns import col, fill_text, fixed


INPUTS = [
    "weight_diff_pct", "value_per_kg", "flag_high_value_density", "flag_low_value_density",
    "origin_country_risk", "dest_country_risk", "route_frequency", "Dwell_Time_Hours",
    "flag_excessive_dwell", "flag_minimal_dwell", "is_night", "is_weekend", "HS_Code",
]


#: Stands between findings that are put together; no finding holds it.
_BREAK = "\x01"


def _listed(template: str, *reasons: Column) -> Column:
    """``template`` filled with the reasons that apply; NULL when none does."""
    found = F.concat_ws(", ", *reasons)  # leaves NULLs out
    return F.when(found != "", fill_text(template, found))


def weight_text() -> Column:
    """Weight gap over 20 percent."""
    pct = col("weight_diff_pct")
    direction = F.when(pct > 0, "higher").otherwise("lower")
    return F.when(F.abs(pct) > 20, fill_text(K.TEXT_WEIGHT, fixed(F.abs(pct), 1), direction))


def value_text() -> Column:
    """Very high or very low value per kilogram."""
    density = col("value_per_kg")
    return F.when(
        col("flag_high_value_density") == 1,
        fill_text(K.TEXT_VALUE_HIGH, fixed(density, 0, grouping=True)),
    ).when(col("flag_low_value_density") == 1, fill_text(K.TEXT_VALUE_LOW, fixed(density, 2)))


def route_text() -> Column:
    """Risky countries and rare routes."""
    origin = col("origin_country_risk")
    return _listed(
        K.TEXT_ROUTE,
        F.when(origin == 2, K.TEXT_ORIGIN_HIGH).when(origin == 1, K.TEXT_ORIGIN_MEDIUM),
        F.when(col("dest_country_risk") == 2, K.TEXT_DEST_HIGH),
        F.when(col("route_frequency") < 3, K.TEXT_RARE_ROUTE),
    )


def dwell_text() -> Column:
    """Very long or very short stays."""
    hours = fixed(col("Dwell_Time_Hours"), 0)
    return F.when(
        col("flag_excessive_dwell") == 1, fill_text(K.TEXT_DWELL_LONG, hours)
    ).when(col("flag_minimal_dwell") == 1, fill_text(K.TEXT_DWELL_SHORT, hours))


def timing_text() -> Column:
    """Night and weekend declarations."""
    return _listed(
        K.TEXT_TIMING,
        F.when(col("is_night") == 1, K.TEXT_NIGHT),
        F.when(col("is_weekend") == 1, K.TEXT_WEEKEND),
    )


def hs_text() -> Column:
    """Controlled commodities."""
    prefix = F.substring(col("HS_Code").cast("string"), 1, 2)
    return F.when(prefix.isin(K.HIGH_RISK_HS), fill_text(K.TEXT_HS, prefix))


def explanation(level: str = "risk_level", score: str = "score") -> Column:
    """The first findings, as many and as worded as the level asks for."""
    found = F.concat_ws(
        _BREAK, weight_text(), value_text(), route_text(), dwell_text(), timing_text(), hs_text()
    )
    # no lambdas, and ``found`` stands in parts that every row needs: Spark then generates code for
    # it and evaluates it once a row
    none, head, tail = found == "", *K.TEXT_MINOR.split("%s")
    short = col(level).isin("High", "Medium")
    minor = ~F.coalesce(short | (col(level) == "Critical"), F.lit(False))
    most = F.when(short, 1).otherwise(2)
    joint = F.when(minor, "; ").otherwise(" ")
    first = F.call_function("substring_index", found, F.lit(_BREAK), most)
    return F.concat(
        F.when(none, fill_text(K.TEXT_NORMAL, fixed(col(score), 2))).when(minor, head).otherwise(""),
        F.replace(first, F.lit(_BREAK), joint),
        F.when(~none & minor, tail).otherwise(""),
    )
