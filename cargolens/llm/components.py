"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs as (id, component): the smallest id that is reachable.

    Large-star and small-star steps take turns until no edge changes; each round is staged, so a
    lost executor costs a re-read. A step keeps one minimum per vertex, never a list of neighbours,
    and partial aggregates shrink hubs before the shuffle. Self-loops and repeated edges are
    harmless; vertices without an edge to another are not in the result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: smaller neighbours and the vertex hang on the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(*(F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in "ab"))
            ).alias("e")
        )
        small = small.select(F.col("e.a").alias("a"), F.col("e.b").alias("b")).filter("a <> b").distinct()
        edges = stage(small, "edges")
        state = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    # at rest every vertex hangs on the minimum of its component
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
