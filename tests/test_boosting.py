import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import boosting, models
from cargolens.operators.boosting import BoostedTrees

NAMES = ["a", "b", "c", "d"]


def table(spark, n=3_000):
    rows = spark.range(n).selectExpr(
        "CAST(id AS STRING) AS Container_ID", "CAST(id * 7919 % 23 AS DOUBLE) AS a", "CAST(id * 104729 % 11 AS DOUBLE) AS b",
        "CAST(id % 500 = 3 AS INT) AS c", "1.5D AS d", "IF(id % 5 = 0, 2.0D, 1.0D) AS class_weight",
    )
    return rows.withColumn("label", F.expr("CAST(a * b > 90 OR c = 1 AND a < 5 AS INT)"))


def brute_force(x, y, w, rounds, depth, rate):
    """Margins by plain recursion over all borders of all features."""

    def grow(rows, target, level):
        mean = np.average(target[rows], weights=w[rows])
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for border in np.unique(x[rows, f])[:-1]:
                left, right = rows[x[rows, f] <= border], rows[x[rows, f] > border]
                parts = [(w[p] @ target[p]) ** 2 / w[p].sum() for p in (left, right, rows)]
                gain = parts[0] + parts[1] - parts[2]
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (left, right))
        if level == depth or best[1] is None:
            out[rows] = mean
            return
        for part in best[1]:
            grow(part, target, level + 1)

    margin = np.zeros(len(y))
    for k in range(rounds):
        out = np.zeros(len(y))
        grow(np.arange(len(y)), y if k == 0 else 4 * y / (1 + np.exp(2 * y * margin)), 0)
        margin = margin + (1.0 if k == 0 else rate) * out
    return margin


def test_trees_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(boosting, "RENEW", 3)  # margins are made anew within the fit
    rows = table(spark)
    model = BoostedTrees(NAMES, rounds=8, depth=3, rate=0.3, share=1.0).fit(rows.repartition(5))
    local = model.transform(rows).select(*NAMES, "label", "class_weight", F.col("rawPrediction").cast("string").alias("raw"), "prediction").toPandas()
    found = local["raw"].str.strip("[]").str.split(",").str[1].astype(float)
    y = 2.0 * local["label"].to_numpy() - 1
    expected = brute_force(local[NAMES].to_numpy(dtype=float), y, local["class_weight"].to_numpy(), 8, 3, 0.3)
    assert np.allclose(found, expected, atol=1e-9)
    assert ((found > 0) == (local["prediction"] == 1)).all()


def test_a_fit_does_not_depend_on_how_rows_are_dealt(spark):
    one, many = (
        models.boosted_trees(NAMES, max_iter=5).fit(table(spark).repartition(n, "Container_ID")).transform(table(spark))
        .select("Container_ID", F.col("probability").cast("string").alias("p")).toPandas().sort_values("Container_ID")
        for n in (1, 7)
    )
    scores = [d["p"].str.strip("[]").str.split(",").str[1].astype(float).to_numpy() for d in (one, many)]
    assert np.allclose(*scores, atol=1e-12)


def test_few_jobs_whatever_the_rounds(spark):
    """One job a level of a tree and a few for the borders."""
    spark.sparkContext.setJobGroup("boosting", "boosting")
    try:
        models.boosted_trees(NAMES, max_iter=12).fit(table(spark))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting")) <= 4 * 12 + 12


def test_borders_of_few_and_of_many_values(spark):
    rows = spark.range(20_000).selectExpr("CAST(id % 1000 = 0 AS INT) AS rare", "CAST(id AS DOUBLE) AS wide", "7 AS same", "id % 50 AS some")
    rare, wide, same, some = boosting.bin_borders(rows, ["rare", "wide", "same", "some"])
    assert rare.tolist() == [0.0] and same.tolist() == [] and len(wide) == len(some) == 31
    steps = np.diff(np.concatenate([[0], wide, [20_000]]))
    assert steps.max() < 3 * 20_000 / 32


def test_odd_tables(spark):
    with pytest.raises(ValueError, match="labels 0 and 1"):
        BoostedTrees(NAMES, rounds=2).fit(table(spark).withColumn("label", F.expr("nullif(label, 1)")))
    with pytest.raises(ValueError, match="labels 0 and 1"):
        BoostedTrees(NAMES, rounds=2).fit(table(spark).limit(0))
    one_class = table(spark).withColumn("label", F.lit(1))
    scored = BoostedTrees(NAMES, rounds=2).fit(one_class).transform(one_class)
    assert scored.where("prediction <> 1").count() == 0


def test_scores_by_places_among_borders_are_those_of_the_plain_walk(spark):
    """Equal to the bit, with values on a border, without a number, without an end, and nodes without a split."""
    rng = np.random.default_rng(5)
    table = [
        {"feature": rng.integers(0, 2, 7).tolist(), "border": [None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 5, 7)],
         "value": rng.normal(size=8).tolist()}
        for _ in range(40)
    ]
    values = [*range(-1, 6), 2.5, float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(float(a), float(b)) for a in values for b in values], "a double, b double")
    model = boosting.BoostedTreesModel().set_trees(["a", "b"], table)
    for row in model.transform(rows).collect():
        margin = 0.0
        for tree in table:
            at = 0
            while at < 7:
                border = tree["border"][at]
                at = 2 * at + (1 if row[tree["feature"][at]] <= (np.inf if border is None else border) else 2)
            margin += tree["value"][at - 7]
        assert row["rawPrediction"][1] == margin
    assert all(array.dtype == "float64" for array in boosting._ranked_trees(table, 3)[0])
