import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cargolens.llm import text as tx
from cargolens.llm.common import in_slots
from cargolens.llm.components import components


def test_hashes_depend_on_content_alone():
    buf, offsets = tx.utf8(pa.array(["ab cd ab", None, "", "x ab"]))
    starts, ends, owner = tx.runs(buf, offsets, tx.NOT_SPACE)
    words = [bytes(buf[a:b]) for a, b in zip(starts, ends)]
    assert words == [b"ab", b"cd", b"ab", b"x", b"ab"] and owner.tolist() == [0, 0, 0, 3, 3]
    hashes = tx.word_hashes(buf, starts, ends)
    assert hashes[0] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 3
    pairs = tx.window_hashes(np.array([1, 2, 3, 1, 2], np.uint64), 2)
    assert pairs[0] == pairs[3] and len(set(pairs.tolist())) == 3


def test_slices_keep_all_rows_and_bound_their_bytes():
    texts = ["x" * n for n in (5, 0, 300, 7, 7, 7, 100, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(tx.slices([batch, batch.slice(0, 0)], "text", 100))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    for p in parts:
        assert p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 100


def test_sliding_min():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 64, 1000):
        x = rng.integers(0, 1000, n).astype(np.uint64)
        for width in (1, 2, 7, 64):
            expected = [x[i : i + width].min() for i in range(max(0, n - width + 1))]
            assert tx.sliding_min(x, width).tolist() == expected


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9), (8, 9)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    label = {v: v for e in edges for v in e}
    for _ in range(len(label)):
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            break
    alone = {v for v in label if all(v not in e or e[0] == e[1] for e in edges)}
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: c for v, c in label.items() if v not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slots_lose_no_row(spark):
    ids = spark.range(0, 100_000, 97).withColumnRenamed("id", "wanted")
    df = spark.range(100_000).select(F.col("id").alias("key"), F.lit("t").alias("text"))
    kept = in_slots(df, F.col("key"), ids)
    assert kept.columns == df.columns
    assert kept.filter("key % 97 = 0").count() == ids.count()
    assert kept.count() < 3 * ids.count()
    assert in_slots(df, F.col("key"), ids.limit(0)).count() == 0
    assert in_slots(df, F.col("key"), ids, max_slots=1 << 15).filter("key % 97 = 0").count() == ids.count()
