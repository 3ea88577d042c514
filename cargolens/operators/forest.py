"""Isolation forest (Liu, Ting, Zhou 2008) as a Spark job (M8, M9).

Fitting: every tree draws its rows by hash, so the drawn rows number about trees x sample
whatever the table size; Spark groups them by tree and each group of a few hundred rows grows
one tree. Scoring: the node table (at most trees x 2 x sample rows) is broadcast and an Arrow
function walks all trees over each batch of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.columns import col

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, length double,"
    " depth int, size int"
)
OVERDRAW = 1.5


def mean_path(size: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``size`` rows."""
    if size <= 1:
        return 0.0
    if size <= 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + np.euler_gamma) - 2.0 * (size - 1.0) / size


def max_depth(sample: int) -> int:
    """Depth at which a tree over ``sample`` rows stops."""
    return max(1, math.ceil(math.log2(sample)))


def _grow(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes of one tree: node, feature, threshold, left, right, length, depth, size.

    Feature -1 is a leaf; size is the number of rows that reached the node.
    """
    nodes, todo, used = [], [(0, x, 0)], 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(low < high)
        if depth >= depth_limit or varied.size == 0:
            nodes.append((node, -1, 0.0, node, node, depth + mean_path(len(rows)), depth, len(rows)))
            continue
        feature = int(rng.choice(varied))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] <= threshold
        nodes.append((node, feature, threshold, used, used + 1, 0.0, depth, len(rows)))
        todo += [(used, rows[goes_left], depth + 1), (used + 1, rows[~goes_left], depth + 1)]
        used += 2
    return nodes


@dataclass
class Forest:
    """Node table with the sample size that its path lengths refer to."""

    nodes: DataFrame
    features: list[str]
    sample: int

    def save(self, path: str) -> None:
        table = self.nodes.withColumn("sample", F.lit(self.sample))
        table = table.withColumn("features", F.lit(",".join(self.features)))
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        table = spark.read.parquet(path)
        head = table.first()
        return Forest(table.drop("sample", "features"), head["features"].split(","), head["sample"])


def draw_rows(
    df: DataFrame, id_col: str, trees: int, sample: int, seed: int, values: Column
) -> DataFrame:
    """Rows for each tree: (tree, draw, x). About OVERDRAW x sample rows per tree.

    Every row of the table takes part in every tree's draw; there is no shuffle of the table.
    """
    rows = df.count()
    key = col(id_col)
    wanted = int(sample * OVERDRAW)

    def draw(tree: Column) -> Column:
        return F.xxhash64(key, tree.cast("long"), F.lit(seed + 1))

    # an exploded list is compiled with the rest of the stage; a lambda over it would be interpreted for each row and tree
    every = df.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    chosen = every.where(F.pmod(draw(col("_tree")), F.lit(max(rows, 1))) < wanted)
    return chosen.select(col("_tree").alias("tree"), draw(col("_tree")).alias("draw"), values.alias("x"))


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    *,
    id_col: str = "Container_ID",
    trees: int = 100,
    sample: int = 256,
    seed: int = 42,
) -> Forest:
    """Fit ``trees`` isolation trees on ``sample`` rows each (M8)."""
    values = F.array(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in features])
    drawn = draw_rows(df, id_col, trees, sample, seed, values)
    used = min(sample, max(2, df.limit(sample).count()))
    depth_limit = max_depth(used)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        lowest = rows.sort_values("draw", kind="stable").head(sample)
        rng = np.random.default_rng([seed, tree])
        nodes = _grow(np.vstack(lowest["x"].to_list()), rng, depth_limit)
        names = ["node", "feature", "threshold", "left", "right", "length", "depth", "size"]
        return pd.DataFrame(nodes, columns=names).assign(tree=tree)[["tree", *names]]

    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    # bounded by trees x 2 x sample rows, so the driver can hold it for the broadcast
    table = nodes.toPandas()
    spark = df.sparkSession
    return Forest(spark.createDataFrame(table, NODE_SCHEMA), list(features), used)


def isolation_score(forest: Forest) -> Column:
    """2 ** (-mean path / c(sample)) per row, near 1 for isolated rows (M9)."""
    spark = forest.nodes.sparkSession
    table = forest.nodes.orderBy("tree", "node").toPandas()
    sizes = table.groupby("tree").size()
    roots = np.concatenate([[0], np.cumsum(sizes.to_numpy())[:-1]])
    start = np.repeat(roots, sizes.to_numpy())
    # a leaf is its own child, so all rows of a batch can take the same number of steps
    children = np.stack([table["right"].to_numpy() + start, table["left"].to_numpy() + start], axis=1)
    shared = spark.sparkContext.broadcast(
        {
            "roots": roots,
            "feature": np.maximum(table["feature"].to_numpy(), 0),
            "threshold": table["threshold"].to_numpy(),
            "children": children.ravel(),
            "length": table["length"].to_numpy(),
        }
    )
    scale, steps = mean_path(forest.sample), max_depth(forest.sample)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        t = shared.value
        x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        cells, row = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for root in t["roots"]:
            at = np.full(len(x), root)
            for _ in range(steps):
                goes_left = np.take(cells, row + np.take(t["feature"], at)) <= np.take(t["threshold"], at)
                at = np.take(t["children"], 2 * at + goes_left)
            total += np.take(t["length"], at)
        return pd.Series(np.exp2(-total / len(t["roots"]) / scale))

    return score(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in forest.features])


def score_bounds(df: DataFrame, raw: str = "isolation") -> tuple[float, float] | None:
    """Lowest and highest isolation score of a batch."""
    found = df.agg(F.min(raw).alias("low"), F.max(raw).alias("high")).first()
    return None if found["low"] is None else (found["low"], found["high"])


def scaled_anomaly(raw: Column, bounds: tuple[float, float]) -> Column:
    """Isolation score mapped to [0, 1], 1 for the most isolated row (M9)."""
    low, high = bounds
    scaled = 1 - (F.lit(high) - raw) / F.lit(high - low + 1e-9)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
