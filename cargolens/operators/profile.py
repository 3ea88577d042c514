"""Table-wide statistics that features need.

A profile holds six moments and three small count tables. Rows are counted once by all keys
together; that table is staged and rolled up for each lookup, while the moments are one global
aggregate. A profile fitted earlier ("frozen") serves new batches and streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.constants import ENCODED_CATEGORIES, EPSILON
from cargolens.functions.columns import col
from cargolens.plans.staging import stage

ROUTE = ["Origin_Country", "Destination_Port"]
#: What the moments are taken of.
MOMENT_SOURCES = {"weight": "weight_diff_abs", "density": "value_per_kg", "dwell": "Dwell_Time_Hours"}
_MOMENTS = list(MOMENT_SOURCES)


@dataclass
class Profile:
    """Moments as plain numbers, counts as staged or stored tables."""

    moments: dict[str, float | None]
    routes: DataFrame
    categories: dict[str, DataFrame]
    medians: dict[str, float] = field(default_factory=dict)
    anomaly_bounds: tuple[float, float] | None = None

    def lookup(self, name: str) -> DataFrame:
        """A count table; Spark broadcasts it only when its files are small enough."""
        return self.routes if name == "route" else self.categories[name]

    def upper(self, name: str, sigmas: float) -> float | None:
        """mean + sigmas * deviation; None when fewer than two rows were seen (T5)."""
        mean, deviation = self.moments[f"{name}_mean"], self.moments[f"{name}_std"]
        if mean is None or deviation is None:
            return None
        return mean + sigmas * (deviation + EPSILON)

    def as_row(self, spark: SparkSession) -> DataFrame:
        """The moments as a one-row DataFrame."""
        names = [f"{m}_{s}" for m in _MOMENTS for s in ("mean", "std")]
        schema = ", ".join(f"{n} double" for n in names)
        return spark.createDataFrame([tuple(self.moments[n] for n in names)], schema)

    def save(self, path: str) -> None:
        """Write the profile below ``path`` for frozen scoring."""
        spark = self.routes.sparkSession
        bounds = self.anomaly_bounds or (None, None)
        fixed_part = self.as_row(spark).select(
            "*",
            F.lit(bounds[0]).cast("double").alias("anomaly_low"),
            F.lit(bounds[1]).cast("double").alias("anomaly_high"),
            F.from_json(F.lit(json.dumps(self.medians)), "map<string,double>").alias("medians"),
        )
        fixed_part.write.mode("overwrite").parquet(f"{path}/moments")
        self.routes.write.mode("overwrite").parquet(f"{path}/route")
        for name, table in self.categories.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Profile:
        row = spark.read.parquet(f"{path}/moments").first().asDict()
        routes = spark.read.parquet(f"{path}/route")
        categories = {c: spark.read.parquet(f"{path}/{c}") for c in ENCODED_CATEGORIES}
        low, high, medians = (row.pop(k) for k in ("anomaly_low", "anomaly_high", "medians"))
        return Profile(
            row,
            routes,
            categories,
            dict(medians or {}),
            None if low is None else (low, high),
        )


def moment_columns() -> list:
    """Mean and sample deviation of weight gap, value density and dwell as one aggregate."""
    return [
        agg(col(c)).alias(f"{name}_{suffix}")
        for name, c in MOMENT_SOURCES.items()
        for suffix, agg in (("mean", F.avg), ("std", F.stddev_samp))
    ]


def route_counts(df: DataFrame) -> DataFrame:
    """Rows per origin and port."""
    return df.na.drop(subset=ROUTE).groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("route_rows"))


def category_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows per category."""
    return df.na.drop(subset=[name]).groupBy(name).agg(F.count(F.lit(1)).alias(f"{name}_rows"))


def fit_profile(
    df: DataFrame, *, staging: Callable[[DataFrame, str], DataFrame] = stage
) -> Profile:
    """Fit all statistics over rows that have weight, value and dwell features.

    Two narrow aggregates read the rows: counts by route and categories together, which are staged
    and rolled up to the lookups, and the moments.
    """
    categories = [c for c in ENCODED_CATEGORIES if c in df.columns]
    keys = list(dict.fromkeys([*ROUTE, *categories]))
    counted = staging(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "profile")
    moments = df.agg(*moment_columns()).first().asDict()

    def lookup(name: str, ks: list[str]) -> DataFrame:
        sums = counted.na.drop(subset=ks).groupBy(*ks).agg(F.sum("_rows").alias(f"{name}_rows"))
        return staging(sums, f"profile-{name}")

    return Profile(moments, lookup("route", ROUTE), {c: lookup(c, [c]) for c in categories})
