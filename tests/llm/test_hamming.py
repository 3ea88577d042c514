import random

import pytest

from cargolens.llm import hamming


def brute(vectors, k, every):
    width = max(len(v) for v in vectors.values() if v)
    bits = {i: [x is not None and x > 0 for x in v] + [False] * (width - len(v)) for i, v in vectors.items() if v}
    out = []
    for q in bits:
        if q % every == 0:
            near = sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits if i != q)
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def found(spark, vectors, k, every):
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in hamming.neighbour_table(rows, k, every).select("query_id", "rank", "vec_id", "distance").collect())


@pytest.mark.parametrize("dims", (8, 64, 100))
def test_like_brute_force(spark, dims):
    rng = random.Random(dims)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    vectors = {i: [x + rng.gauss(0, 0.5) for x in rng.choice(centres)] for i in range(500)}
    vectors |= {i: list(centres[0]) for i in range(500, 650)}  # a vector that many rows repeat
    vectors |= {900: None, 901: [], 902: [float("nan")] * dims, 903: [1.0, None]}
    assert found(spark, vectors, 7, 50) == brute({i: v and [0 if x != x else x for x in (y or 0 for y in v)] for i, v in vectors.items()}, 7, 50)


def test_small_and_empty_tables(spark):
    assert found(spark, {0: [1.0], 1: [1.0], 2: [-1.0]}, 10, 1) == brute({0: [1.0], 1: [1.0], 2: [-1.0]}, 10, 1)
    assert found(spark, {0: [1.0]}, 3, 1) == []
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.neighbour_table(none).count() == 0


def test_rows_that_repeat_ids_with_other_codes(spark):
    """A query's own rows are no neighbours, however many there are, and the k nearest others come whole."""
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 100, rng.randrange(300)]), [rng.gauss(0, 1) for _ in range(12)]) for _ in range(400)]
    rows += [(0, [1.0] * 12), (0, [1.0] * 11 + [-1.0]), (1, [1.0] * 12), (2, [1.0] * 12), (100, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = hamming.neighbour_table(df, 3, 100)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in out.collect())
    codes = {(i, tuple(x > 0 for x in v)) for i, v in rows}
    expected = []
    for q, code in codes:
        if q % 100 == 0:
            near = sorted((sum(a != b for a, b in zip(code, c)), i) for i, c in codes if i != q)
            expected += [(q, rank, i, d) for rank, (d, i) in enumerate(near[:3], 1)]
    assert found == sorted(expected)
