"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments, and an index finds codes by the value of a segment. A round probes, in
every segment, all values at one more bit flip from the query's; after the round for radius s every
code within m * (s + 1) - 1 bits (m: number of segments) has been met, since m segments cannot all
differ in more than s bits. Candidates are verified on the whole code. A query leaves when its k-th
verified distance is within the bound, which proves that nothing nearer is left.

Equal codes are one entry that keeps its k + 1 smallest ids, more than any answer can use of them, so
a vector that a third of the table repeats is no hot bucket; equal queries are searched once, those whose id
stands in the table with other codes too each for itself and without the rows of its id.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.plans.staging import stage

WORD = 64


def sign_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): one bit for each dimension, set where it is over zero, in longs of 64 bits.

    Vectors shorter than the longest are filled up with zero bits; NaN and null are zero bits. Rows
    without id, and null and empty vectors, are left out.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND size(v) > 0")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    zero = F.lit(0).cast("long")

    def word(k: int) -> Column:
        part = F.slice("v", k * WORD + 1, WORD)
        bits = F.transform(
            part, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero)
        )
        return F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(b))

    words = [word(k) for k in range(-(-longest // WORD))] or [zero]
    return rows.select("id", F.array(*words).alias("code"))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two codes."""
    counts = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.bit_count(p["a"].bitwiseXOR(p["b"])))
    return F.aggregate(counts, F.lit(0), lambda x, y: x + y)


def segment_width(codes: int) -> int:
    """Bits of a segment: about log2 of the number of codes, so that buckets hold a few codes.

    Above 16 bits the flips of a round would be too many to list.
    """
    return 8 if codes < 1 << 12 else 16


def _segments(width: int, words: int) -> Column:
    """(segment, value) of a code's segments."""
    a_word = WORD // width
    mask = (1 << width) - 1
    return F.array(
        *(
            F.struct(
                F.lit(w * a_word + s).alias("segment"),
                F.shiftrightunsigned(F.element_at("code", w + 1), s * width)
                .bitwiseAND(F.lit(mask).cast("long"))
                .alias("value"),
            )
            for w in range(words)
            for s in range(a_word)
        )
    )


def nearest(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of ``codes`` (id, code) for each of ``queries`` (id, code).

    query_id, rank, id, distance: by distance, then id; a row is not its own neighbour. Fewer than k
    rows come where the table has fewer. Repeated ids are one row for each different code; none of the rows
    of its own id is a query's neighbour, and the k others come whole all the same.
    """
    codes = stage(codes.select("id", "code").distinct(), "codes")
    entries = _entries(codes, k)
    entries = stage(entries, "entries")
    queries = queries.select("id", "code").distinct()
    # whose rows do not count, where the table holds others of the id than the query itself
    often = codes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.col("id").alias("own"))
    queries = stage(queries.join(often, "id", "left"), "queries-own")
    active = stage(queries.select("code", "own").distinct(), "queries")
    size = entries.agg(F.count("*").alias("codes"), F.max(F.size("code")).alias("words")).first()
    total = codes.limit(k + 1).count()
    empty = "query_id long, rank int, id long, distance int"
    if not size["codes"]:
        return codes.sparkSession.createDataFrame([], empty)
    words, width = size["words"], segment_width(size["codes"])
    segments = words * (WORD // width)
    index = stage(
        entries.select("code", "ids", F.explode(_segments(width, words)).alias("s")).select("s.*", "code", "ids"),
        "index",
    )
    best, finished = None, []
    for radius in range(width + 1):
        met = _probed(active, index, width, words, radius)
        met = met if best is None else met.unionByName(best).distinct()
        order = W.partitionBy("query", "own").orderBy("distance", "id")
        best = stage(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).drop("rank"), "best")
        covered = segments * (radius + 1) - 1
        state = best.groupBy("query", "own").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
        enough = F.when(F.col("own").isNull(), total).otherwise(min(total, k))
        done = state.filter((F.col("n") >= enough) & (F.col("worst") <= covered) | F.lit(radius == width))
        done = stage(done.select(F.col("query").alias("done_query"), F.col("own").alias("done_own")), "done")
        same = (F.col("query") == F.col("done_query")) & F.col("own").eqNullSafe(F.col("done_own"))
        finished.append(best.join(done, same, "left_semi"))
        best = best.join(done, same, "left_anti")
        same = (F.col("code") == F.col("done_query")) & F.col("own").eqNullSafe(F.col("done_own"))
        active = stage(active.join(done, same, "left_anti"), "active")
        if active.isEmpty():
            break
    found = finished[0]
    for part in finished[1:]:
        found = found.unionByName(part)
    found = found.select("query", F.col("own").alias("found_own"), "distance", "id")
    mine = queries.select(F.col("id").alias("query_id"), F.col("code").alias("own_code"), "own")
    same = (F.col("own_code") == F.col("query")) & F.col("own").eqNullSafe(F.col("found_own"))
    answers = mine.join(found, same)
    order = W.partitionBy("query_id", "query").orderBy("distance", "id")
    answers = answers.filter("id <> query_id").withColumn("rank", F.row_number().over(order))
    return answers.filter(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance"))


def _probed(active: DataFrame, index: DataFrame, width: int, words: int, radius: int) -> DataFrame:
    """Rows in the buckets at ``radius`` flips from the queries' segments; at most C(16, 8) flips are listed."""
    flips = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
    masks = F.array(*(F.lit(f).cast("long") for f in flips)) if len(flips) < 64 else F.from_json(
        F.lit(str(flips)), "array<bigint>"
    )
    probes = active.select("code", "own", F.explode(_segments(width, words)).alias("s"))
    probes = probes.select(
        F.col("code").alias("query"),
        "own",
        "s.segment",
        F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("s.value")))).alias("value"),
    )
    # Spark takes the probes for as few as the queries and would broadcast them
    met = probes.hint("merge").join(index, ["segment", "value"]).select("query", "own", "code", "ids")
    rows = met.select(
        "query", "own", "code", distance(F.col("query"), F.col("code")).alias("distance"), F.explode("ids").alias("id")
    ).distinct()
    return rows.filter("own IS NULL OR id <> own")


def _entries(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): each different code with its k + 1 smallest ids."""
    order = W.partitionBy("code").orderBy("id")
    rows = codes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    return rows.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def neighbour_table(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, distance: the ``k`` nearest codes of each row whose id ``every`` divides."""
    codes = sign_codes(vectors)
    queries = codes.filter(F.col("id") % every == 0)
    return nearest(codes, queries, k).withColumnRenamed("id", "vec_id")
