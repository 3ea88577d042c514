"""Profiles that take in batches without reading old rows again.

The state of a batch is small and adds up: per measure the number of values, their mean and the sum
of squared deviations; rows per route and categories together; and a quantile sketch (KLL) of each
column that C5 fills. States of batches are kept side by side below one folder, so a batch that is taken in
again replaces its own state, and a profile is the merge of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.constants import CRITICAL_COLUMNS, ENCODED_CATEGORIES, MEASURES
from cargolens.functions.columns import col
from cargolens.operators.profile import MOMENT_SOURCES, ROUTE, Profile
from cargolens.plans.staging import stage

#: Size of a quantile sketch. A rank that it gives is off by under 0.1 % of the rows with 99 % confidence.
SKETCH_K = 4096
RANK_ERROR = 0.001
#: Columns that C5 fills in.
FILLED = [c for c in MEASURES if c not in CRITICAL_COLUMNS]


def moment_state(df: DataFrame) -> DataFrame:
    """(measure, n, mean, m2) of a batch in one pass; m2 is the sum of squared deviations from the mean."""
    sums = df.agg(
        *(F.count(col(c)).alias(f"{name}_n") for name, c in MOMENT_SOURCES.items()),
        *(F.avg(col(c)).alias(f"{name}_mean") for name, c in MOMENT_SOURCES.items()),
        *(F.var_pop(col(c)).alias(f"{name}_var") for name, c in MOMENT_SOURCES.items()),
    )
    rows = [
        F.struct(
            F.lit(name).alias("measure"),
            col(f"{name}_n").alias("n"),
            F.coalesce(col(f"{name}_mean"), F.lit(0.0)).alias("mean"),
            F.coalesce(col(f"{name}_var") * col(f"{name}_n"), F.lit(0.0)).alias("m2"),
        )
        for name in MOMENT_SOURCES
    ]
    return sums.select(F.inline(F.array(*rows)))


def merge_moments(states: DataFrame) -> DataFrame:
    """Several states as one: two at a time, each pair by the mean of both and the gap between them.

    A measure has one row per batch, so the lists that are folded are as long as there are batches.
    """
    def both(a, b):
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        part = b["n"] / F.greatest(n, F.lit(1))
        return F.struct(
            n.alias("n"),
            (a["mean"] + gap * part).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["n"] * part).alias("m2"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    parts = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))
    merged = states.groupBy("measure").agg(F.aggregate(parts, zero, both).alias("s"))
    return merged.select("measure", "s.*")


def count_state(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Rows per route and categories together."""
    keys = list(dict.fromkeys([*ROUTE, *categories]))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def sketch_state(df: DataFrame, columns: Sequence[str] = FILLED) -> DataFrame:
    """(column, sketch) of a batch in one pass; nulls are left out."""
    sketches = [F.kll_sketch_agg_double(col(c).cast("double"), SKETCH_K).alias(f"s{i}") for i, c in enumerate(columns)]
    rows = [F.struct(F.lit(c).alias("column"), col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return df.agg(*sketches).select(F.inline(F.array(*rows))).where("sketch IS NOT NULL")


def merge_sketches(states: DataFrame) -> DataFrame:
    return states.groupBy("column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


class ProfileLog:
    """States of batches below one folder and the profile they add up to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, batch_id: str, df: DataFrame, unfilled: DataFrame | None = None) -> None:
        """Take in a batch of cleaned rows with measures; the same batch again replaces itself.

        ``unfilled`` holds the batch's rows before C5, whose medians the sketches are for; without
        it there are none. The batch is read by three narrow aggregates.
        """
        categories = [c for c in ENCODED_CATEGORIES if c in df.columns]
        self._write("moments", batch_id, moment_state(df))
        self._write("counts", batch_id, count_state(df, categories))
        if unfilled is not None:
            present = [c for c in FILLED if c in unfilled.columns]
            self._write("sketches", batch_id, sketch_state(unfilled, present))

    def _write(self, table: str, batch_id: str, state: DataFrame) -> None:
        few = state.coalesce(1) if table != "counts" else state
        few.write.mode("overwrite").parquet(f"{self.path}/{table}/batch_id={batch_id}")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}").drop("batch_id")

    def moments(self) -> DataFrame:
        return merge_moments(self._read("moments"))

    def counts(self) -> DataFrame:
        counts = self._read("counts")
        keys = [c for c in counts.columns if c != "rows"]
        return counts.groupBy(*keys).agg(F.sum("rows").alias("rows"))

    def medians(self) -> dict[str, float]:
        """Medians of the filled columns, within ``RANK_ERROR`` of the middle rank."""
        sketches = merge_sketches(self._read("sketches")).where(F.kll_sketch_get_n_double("sketch") > 0)
        found = sketches.select(
            "column", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("median")
        )
        return {r["column"]: r["median"] for r in found.collect()}  # a row per column

    def profile(self, *, staging: Callable[[DataFrame, str], DataFrame] = stage, medians: bool = True) -> Profile:
        """The profile of all batches, for scoring; old rows are not read."""
        found = {}
        for r in self.moments().collect():  # a row per measure
            found[f"{r['measure']}_mean"] = r["mean"] if r["n"] else None
            found[f"{r['measure']}_std"] = (r["m2"] / (r["n"] - 1)) ** 0.5 if r["n"] > 1 else None
        counts = self.counts()

        def lookup(name: str, keys: list[str]) -> DataFrame:
            sums = counts.na.drop(subset=keys).groupBy(*keys).agg(F.sum("rows").alias(f"{name}_rows"))
            return staging(sums, f"profile-{name}")

        categories = {c: lookup(c, [c]) for c in ENCODED_CATEGORIES if c in counts.columns}
        return Profile(found, lookup("route", ROUTE), categories, self.medians() if medians else {})

