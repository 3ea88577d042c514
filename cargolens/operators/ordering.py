"""Whole-table order (ranks, neighbours, running sums) without a single-task sort.

The rows are range-partitioned on the full ordering key, so a score that many rows share is
still cut into equal parts by the tie-breaking id. The partitioned table is staged, because
range bounds are sampled and must not be drawn twice. Each part is then ordered on its own and
shifted by the totals of the parts before it; there are as many totals as partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.columns import col
from cargolens.plans.staging import stage

PART = "_part"


def ordered_parts(
    df: DataFrame,
    order: Sequence[Column],
    *,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Stage ``df`` in key ranges; ``_part`` numbers the ranges in key order.

    The number of ranges is left open: Spark starts at the session's number of shuffle partitions
    and merges neighbouring small ranges, which keeps their order.
    """
    ranged = df.repartitionByRange(*order)
    return staging(ranged.withColumn(PART, F.spark_partition_id()), "ordered")


def running_sums(
    parts: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add inclusive running sums over the whole order to an ``ordered_parts`` table."""
    totals = parts.groupBy(PART).agg(*[F.sum(c).alias(f"_{n}_total") for n, c in sums.items()])
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        col(PART),
        *[F.coalesce(F.sum(f"_{n}_total").over(before), F.lit(0)).alias(f"_{n}_shift") for n in sums],
    )
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({f"_{n}_own": F.sum(c).over(within) for n, c in sums.items()})
    # one row per partition: the size bound of this broadcast is the partition number
    return (
        summed.join(F.broadcast(shifts), PART)
        .withColumns({n: col(f"_{n}_own") + col(f"_{n}_shift") for n in sums})
        .drop(*[f"_{n}_own" for n in sums], *[f"_{n}_shift" for n in sums])
    )


def with_rank(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "rank",
    *,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """1-based position of every row in the given total order."""
    parts = ordered_parts(df, order, staging=staging)
    return running_sums(parts, order, {name: F.lit(1).cast("long")}).drop(PART)


def with_neighbours(
    df: DataFrame,
    order: Sequence[Column],
    key: str,
    *,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Rank of every row and the ``key`` of the rows just before and after it.

    ``lag`` and ``lead`` share the ranges and the sort of the rank. Only the first and last row
    of a range look outside it, into a table with one row per range.
    """
    parts = ordered_parts(df, order, staging=staging)
    within = Window.partitionBy(PART).orderBy(*order)
    ranked = running_sums(parts, order, {"rank": F.lit(1).cast("long")}).withColumns(
        {"prev": F.lag(key).over(within), "next": F.lead(key).over(within)}
    )
    edges = (
        ranked.where(col("prev").isNull() | col("next").isNull())
        .groupBy(PART)
        .agg(F.min_by(key, "rank").alias("first"), F.max_by(key, "rank").alias("last"))
    )
    ranges = Window.orderBy(PART)
    outside = edges.select(
        PART,
        F.lag("last").over(ranges).alias("_before"),
        F.lead("first").over(ranges).alias("_after"),
    )
    # one row per partition, as above
    return (
        ranked.join(F.broadcast(outside), PART)
        .withColumns(
            {
                f"prev_{key}": F.coalesce("prev", "_before"),
                f"next_{key}": F.coalesce("next", "_after"),
            }
        )
        .drop(PART, "prev", "next", "_before", "_after")
    )
