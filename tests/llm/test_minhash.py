import random

import numpy as np
from pyspark.sql import functions as F

from cargolens.llm import minhash
from tests.llm.test_pipeline import classes, words


def templated(rng, n, size=120):
    """Pages that share half of their words, and some near copies of pages that the centre refuses."""
    shared, pages = words(rng, size), {}
    for d in range(n):
        part = rng.randint(size * 55 // 100, size * 85 // 100)
        pages[d] = " ".join(shared[:part] + [f"{w}{d}" for w in words(rng, size - part)])
        if d % 5 == 4:
            copy = pages[rng.randrange(d)].split()
            copy[-1] += "x"
            pages[d] = " ".join(copy)
    return pages


def test_templated_pages_leave_few_to_compare(spark, monkeypatch):
    """Members that share nothing but the template are not compared; blocks keep to both bounds."""
    seen = []
    keep = minhash._may_be_linked

    def spied(tried):
        out = keep(tried)
        seen.append((tried.filter("NOT linked").count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "_may_be_linked", spied)
    monkeypatch.setattr(minhash, "BLOCK_DIFFERENCES", 300)
    rng = random.Random(8)
    texts = templated(rng, 300)
    texts |= {1000 + d: " ".join(texts[0].split()[:60][: 30 + d]) for d in range(12)}  # parts of the template alone
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 4, 80).collect()}
    assert got == classes(texts, 4, 80)
    refused, left = seen[0]
    assert refused > 100 and left < refused


def test_common_differences():
    rng = np.random.default_rng(3)
    lists = [np.unique(rng.integers(0, 40 if k % 3 else 4000, 30)) for k in range(200)]
    found = minhash._CommonDifferences(np.concatenate(lists), np.array([len(x) for x in lists]))
    others = np.arange(5, 200, 2)
    for r in (0, 1, 77, 199):
        assert found.common(r, others).tolist() == [len(np.intersect1d(lists[r], lists[m])) for m in others]


def test_differences_of_a_block_are_bounded(spark, monkeypatch):
    """The differences of a group bound its blocks, not only its members."""
    monkeypatch.setattr(minhash, "BLOCK_DIFFERENCES", 100)
    rows = [(i, -1, i % 2 == 0, 100, [7, *range(1000 * i, 1000 * i + 40)], 5, [7], False) for i in range(1, 21)]
    kind = (
        "id long, centre long, linked boolean, size long, differences array<long>, against long, "
        "first array<long>, short boolean"
    )
    tried = spark.createDataFrame(rows, kind)
    links = tried.filter("linked").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    frames = []
    frame = type(tried).repartition

    def spied(self, *keys):
        if "refused_blocks" in keys:
            frames.append(self)
        return frame(self, *keys)

    monkeypatch.setattr(type(tried), "repartition", spied)
    minhash._between_members(tried, links, 80).collect()
    keys = ["centre", "refused_blocks", "blocks"]
    sides = frames[0].groupBy(*keys).agg(F.sum(F.size("differences")).alias("n")).collect()
    assert len(sides) > 20 and max(r["n"] for r in sides) < 20 * 41 // 2
