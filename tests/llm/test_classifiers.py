import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cargolens.llm import quality, toxicity


def auc(label, score):
    label, score = np.asarray(label), np.asarray(score)
    order = score.argsort(kind="stable").argsort() + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / n / (len(label) - n)


CASES = {
    "quality": (quality.quality_scores, 3, 1, 0.95),
    "toxic": (toxicity.toxicity_scores, 5, 0, 0.8),
}


@pytest.mark.parametrize("column", CASES)
def test_held_out_documents(spark, column):
    make, folds, fold, least = CASES[column]
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in make(docs, labels).collect()}
    assert len(rows) == docs.count()
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r[column], rows[r["doc_id"]]["score"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert auc(*zip(*held)) > least
    # labels of the held-out fold, and the other columns, have no influence
    mask = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold
    turned = labels.withColumn(column, F.when(mask, 1 - F.col(column)).otherwise(F.col(column)))
    bare = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit("s").alias("source"))
    again = {r["doc_id"]: r["score"] for r in make(bare, turned).collect()}
    assert all(abs(again[d] - rows[d]["score"]) < 1e-9 for d in rows)


@pytest.mark.parametrize("column", CASES)
def test_odd_rows_and_missing_labels(spark, column):
    make = CASES[column][0]
    texts = [(i, f"plain words number {i} and more of them here", 1, 2) for i in range(40)]
    texts += [(100, None, 1, 2), (101, "", 1, 2), (102, " \n", 1, 2), (103, "x" * 300_000, 1, 2), (None, "no id", 1, 2), (1, texts[1][1], 1, 2)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score int, _statistics int")
    kind = f"doc_id long, {column} int, extra int"
    none = spark.createDataFrame([], kind)
    one = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, 0), (3, None, 0)], kind)
    for labels in (none, one):
        rows = make(docs, labels).collect()
        assert len(rows) == len(texts) and len({r["score"] for r in rows}) == 1
        assert not next(r for r in rows if r["doc_id"] is None)["held_out"]
    assert make(docs.limit(0), one).count() == 0


def test_statistics_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["A b b.", "", "!!! ||| AAA", "é é\né é", None, "x"]
    together = quality.statistics(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert np.array_equal(quality.statistics(pa.array([t], pa.string()))[0], together[k])
    value = dict(zip(quality.STATISTICS, together[0]))
    assert value["words"] == pytest.approx(np.log(4)) and value["capitals"] == pytest.approx(1 / 3)
    assert dict(zip(quality.STATISTICS, together[3]))["repeated_lines"] == 0.5


def test_rules_are_sparse_and_compiled(spark):
    rows = [(float(i % 2), [0.0] * len(quality.STATISTICS)) for i in range(200)]
    for i, (label, x) in enumerate(rows):
        x[3], x[5] = label * 2 + (i % 7) / 10, (i % 13) / 13
    training = spark.createDataFrame(rows, "label double, statistics array<double>")
    model = quality.fit(training)
    assert 0 < len(model.rules) < 60 and all(w for _, w in model.rules)
    scored = training.select("label", model.score(F.col("statistics")).alias("s")).collect()
    assert all((r["s"] >= 0.5) == (r["label"] == 1) for r in scored)


def test_a_repeated_document_is_fitted_once(spark, monkeypatch):
    texts = [(i, f"plain words number {i} and {'bad ' * (i % 2)}more of them") for i in range(60)]
    kind = "doc_id long, text string"
    docs = spark.createDataFrame(texts, kind)
    hot = docs.unionByName(spark.createDataFrame([t for t in texts if t[0] % 7 == 3] * 30, kind)).repartition(5)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    once, again = toxicity.train(docs, labels), toxicity.train(hot, labels)
    assert np.array_equal(once.table, again.table) and np.allclose(once.weights, again.weights)
    rows = []
    monkeypatch.setattr(quality, "fit", lambda training: rows.append(training.count()))
    quality.train(docs, labels)
    quality.train(hot, labels)
    assert rows[0] == rows[1] > 20


def test_grams_stay_inside_their_text():
    texts = ["abc  Def", "", "1é", None]
    found, offsets = toxicity.symbols(pa.array(texts, pa.string()))
    code, owner = toxicity.grams(found, offsets)
    alone = [toxicity.grams(*toxicity.symbols(pa.array([t], pa.string())))[0].tolist() for t in texts]
    assert [code[owner == k].tolist() for k in range(4)] == alone and alone[1] == []
    assert alone[0][0] == 1 and alone[0][2] == (1 << 10) + (2 << 5) + 3


def test_backoff_and_class_models_are_distributions():
    rng = np.random.default_rng(1)
    gram = np.unique(rng.integers(0, toxicity.SYMBOLS**toxicity.ORDER, 3000))
    lower = toxicity._shared_backoff(gram)
    assert lower.shape == (toxicity.SYMBOLS ** (toxicity.ORDER - 2), toxicity.SYMBOLS)
    assert np.allclose(lower.sum(1), 1)
    table = toxicity.ratio_table(gram, np.ones(len(gram)), np.ones(len(gram)))
    assert not table.any()
    table = toxicity.ratio_table(gram, (gram == gram[0]) * 50.0, np.ones(len(gram)))
    assert table[gram[0]] > 0


def test_ratios_are_those_of_plain_kneser_ney_counts():
    """Discounted class counts over shared continuation counts, one gram after the other from dictionaries."""
    import math
    import random
    from collections import Counter, defaultdict

    rng = random.Random(4)
    order, base, d = toxicity.ORDER, toxicity.SYMBOLS, toxicity.DISCOUNT
    texts = {
        kind: ["".join(rng.choices("abcde ", [4, 2, 2, 1, 1, 3], k=200)) + odd for _ in range(12)]
        for kind, odd in (("toxic", " bad bad"), ("ordinary", " good"), ("every", " rare"))
    }
    counts = {kind: Counter() for kind in texts}
    for kind, rows in texts.items():
        for t in rows:
            code, _ = toxicity.grams(*toxicity.symbols(pa.array([t])))
            for c in code.tolist():
                counts[kind][tuple((c >> 5 * (order - 1 - i)) & (base - 1) for i in range(order))] += 1
    seen = set().union(*counts.values())
    before = defaultdict(set)  # sequence: the symbols that stand before it in a longer seen one
    for gram in seen:
        for width in range(1, order):
            before[gram[-width:]].add(gram[-width - 1])
    followers = defaultdict(list)
    for sequence in before:
        followers[sequence[:-1]].append(sequence)

    def lower(sequence):
        if not sequence:
            return 1 / base
        kin = followers[sequence[:-1]]
        total = sum(len(before[k]) for k in kin)
        if not total:
            return lower(sequence[1:]) if len(sequence) > 1 else 1 / base
        own = max(len(before[sequence]) - d, 0) / total if sequence in before else 0
        return own + d * len(kin) / total * (lower(sequence[1:]) if len(sequence) > 1 else 1 / base)

    def chance(gram, kind):
        kin = [g for g in counts[kind] if g[:-1] == gram[:-1]]
        total = sum(counts[kind][g] for g in kin)
        if not total:
            return lower(gram[1:])
        return max(counts[kind][gram] - d, 0) / total + d * len(kin) / total * lower(gram[1:])

    number = lambda g: sum(s << 5 * (order - 1 - i) for i, s in enumerate(g))
    grams = sorted(seen, key=number)
    columns = (np.array([counts[k][g] for g in grams]) for k in ("toxic", "ordinary"))
    table = toxicity.ratio_table(np.array([number(g) for g in grams]), *columns)
    unseen = [tuple(rng.randrange(6) for _ in range(order)) for _ in range(300)]
    for gram in [*grams, *unseen]:
        exact = math.log(chance(gram, "toxic")) - math.log(chance(gram, "ordinary"))
        assert abs(table[number(gram)] * toxicity.STEP - max(min(exact, 127 * toxicity.STEP), -127 * toxicity.STEP)) <= 0.51 * toxicity.STEP


def test_scores_are_those_of_the_rules_one_by_one(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    assert len(model.rules) > 1
    rows = quality.scored(docs.select("doc_id", "text"), model).collect()
    for r in rows:
        found = quality.statistics(pa.array([r["text"]], pa.string()))[0].tolist()
        total = model.intercept
        for rule, weight in model.rules:
            if all(low < found[k] <= high for k, low, high in rule):
                total += weight
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)
