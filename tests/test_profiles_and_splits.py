import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import models, selection
from cargolens.operators.cleaning import clean
from cargolens.operators.descent import fit_descent
from cargolens.operators.features import engineer_features, with_measures
from cargolens.operators.labels import label_retrain
from cargolens.operators.profile import fit_profile
from cargolens.operators.profile_state import RANK_ERROR, ProfileLog
from cargolens.plans.staging import stage
from cargolens.plans.testtables import ORDER, rule_scores, shipments
from cargolens.sources.store import BatchStore, ModelStore
from cargolens.streaming import streams


@pytest.fixture(scope="module")
def cleaned(spark, small):
    return stage(clean(shipments(spark, small), ORDER), "cleaned")


# --- profiles ---------------------------------------------------------------------------


def same_profile(a, b):
    for name, value in a.moments.items():
        assert b.moments[name] == pytest.approx(value, rel=1e-9)
    for name in ("route", *a.categories):
        assert sorted(a.lookup(name).collect()) == sorted(b.lookup(name).select(a.lookup(name).columns).collect())


def test_merged_batches_equal_the_whole(spark, cleaned, tmp_path):
    rows = with_measures(cleaned)
    log = ProfileLog(spark, str(tmp_path / "log"))
    parts = [rows.where(F.crc32(F.col("Container_ID").cast("binary")) % 7 == i) for i in range(7)]
    for i, part in enumerate([*parts, rows.limit(0), parts[0]]):  # the eighth is empty, the ninth replaces the first
        log.add(f"b{i if i < 8 else 0}", part, part)
    same_profile(fit_profile(rows), log.profile())
    values = np.sort([r[0] for r in rows.select("Dwell_Time_Hours").collect()])
    median = log.medians()["Dwell_Time_Hours"]
    below, upto = np.searchsorted(values, [median, np.nextafter(median, np.inf)]) / len(values)
    assert below <= 0.5 + RANK_ERROR and upto >= 0.5 - RANK_ERROR
    # merged statistics serve features as fitted ones do
    names = ["Container_ID", "flag_high_value_density", "route_frequency", "Shipping_Line_encoded"]
    a = engineer_features(cleaned, fit_profile(rows)).select(names)
    b = engineer_features(cleaned, log.profile()).select(names)
    assert sorted(a.collect()) == sorted(b.collect())


def test_profiles_of_nothing_and_of_one_row(spark, cleaned, tmp_path):
    rows = with_measures(cleaned)
    log = ProfileLog(spark, str(tmp_path))
    log.add("none", rows.limit(0), rows.limit(0))
    assert set(log.profile().moments.values()) == {None} and log.medians() == {}
    log.add("one", rows.limit(1), rows.limit(1))
    assert log.profile().moments["dwell_std"] is None and log.profile().moments["dwell_mean"] is not None


def test_moments_far_from_zero_keep_their_digits(spark, tmp_path):
    """Sums of squares would lose the deviation here; means and gaps do not."""
    from cargolens.operators.profile_state import merge_moments, moment_state

    values = [1e9 + x for x in random.Random(1).choices(range(10), k=3000)]
    kind = "weight_diff_abs double, value_per_kg double, Dwell_Time_Hours double"
    states = [moment_state(spark.createDataFrame([(v, None, 1.0) for v in values[i::5]], kind)) for i in range(5)]
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    found = {r["measure"]: r for r in merge_moments(whole).collect()}
    assert found["weight"]["m2"] / 2999 == pytest.approx(np.var(values, ddof=1), rel=1e-6)
    assert (found["density"]["n"], found["dwell"]["m2"]) == (0, 0.0)


# --- splits -----------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_ranks_of_groups(spark, limit):
    rng = random.Random(limit)
    rows = [("a", rng.randrange(10**15)) for _ in range(900)] + [("b", rng.randrange(5)) for _ in range(400)]
    rows += [("c", 7)] * 300 + [("d", 1), (None, 3), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    rank = lambda n: int(n * 0.3) - (n == 1)
    found = selection.order_statistic_of_groups(df, F.col("g"), F.col("v"), rank, limit=limit)
    expected = {}
    for g in "abc":
        values = sorted(v for x, v in rows if x == g and v is not None)
        expected[g] = values[rank(len(values))]
    assert found == expected


def test_each_class_is_split_to_the_row(spark):
    rows = [(f"C{i}", int(i % 11 == 0)) for i in range(1003)] + [("only", 7), ("none", None)]
    sides = models.stratified_split(spark.createDataFrame(rows, "Container_ID string, label int"))
    train, test = ([(r["Container_ID"], r["label"]) for r in d.collect()] for d in sides)
    assert sorted(map(str, train + test)) == sorted(map(str, rows))
    for label in (0, 1, 7, None):
        n = sum(1 for _, x in rows if x == label)
        assert sum(1 for _, x in test if x == label) == (0 if label is None else int(0.2 * n + 0.5))


# --- gradient descent -------------------------------------------------------------------


def plain_descent(x, y, rate, steps, reg):
    m, n = x.shape
    w, b, losses = np.zeros(n), 0.0, []
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500)))
        losses.append(-np.mean(y * np.log(p + 1e-15) + (1 - y) * np.log(1 - p + 1e-15)) + reg / (2 * m) * np.sum(w**2))
        w, b = w - rate * (x.T @ (p - y) / m + reg / m * w), b - rate * np.mean(p - y)
    return w, b, losses


def test_descent_agrees_with_a_plain_recursion(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(5, 3, 400), rng.integers(0, 2, 400), np.full(400, 2.0)])
    y = (x[:, 0] + 4 * x[:, 1] + rng.normal(0, 2, 400) > 7).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, label double")
    scales = {"a": (5.0, 3.0), "c": (2.0, 0.0)}
    found = fit_descent(df.repartition(5), ["a", "b", "c"], rate=0.5, steps=40, reg=2.0, scales=scales)
    w, b, losses = plain_descent((x - [5, 0, 2]) / [3, 1, 1], y, 0.5, 40, 2.0)
    assert found.weights == pytest.approx(w.tolist()) and found.bias == pytest.approx(b)
    assert found.losses == pytest.approx(losses) and found.losses[-1] < found.losses[0]
    scored = df.select(F.expr(found.score_sql()).alias("p")).collect()
    assert [r["p"] for r in scored] == pytest.approx((1 / (1 + np.exp(-((x - [5, 0, 2]) / [3, 1, 1] @ w + b)))).tolist())
    assert fit_descent(df.limit(0), ["a"]).losses == []


def test_a_descent_model_goes_through_the_store(spark, cleaned, tmp_path):
    features = stage(label_retrain(engineer_features(cleaned), "label"), "features")
    model = models.train(features, use_descent=True, exact_split=True, max_iter=15, trees=5)
    n = {r["label"]: r["count"] for r in features.groupBy("label").count().collect()}
    assert model.stats["test_size"] == sum(int(0.2 * k + 0.5) for k in n.values())
    assert len(model.stats["losses"]) == 15 and model.stats["losses"][-1] < model.stats["losses"][0]
    assert model.stats["auc"] > 0.6
    store = ModelStore(spark, str(tmp_path))
    store.save(model, fit_profile(with_measures(cleaned)))
    again, _ = store.load()
    names = ["Container_ID", "classifier_score"]
    a, b = (models.classifier_scores(features, m).select(names).collect() for m in (model, again))
    assert sorted(a) == sorted(b) and all(0 <= r["classifier_score"] <= 1 for r in a)


# --- streams ----------------------------------------------------------------------------


def test_first_in_order_whatever_arrives_first(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"C{i % 40}", f"2024-01-{1 + i % 3:02} 10:00:00", rng.randrange(10**6), i) for i in range(600)]
    rows += [("hot", "2024-01-02 00:00:00", rng.randrange(10**6), i) for i in range(900)]
    rng.shuffle(rows)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    kind = "Container_ID string, at string, place long, n int"
    for i in range(4):
        spark.createDataFrame(rows[i::4], kind).coalesce(1).write.mode("append").parquet(source)
    df = spark.createDataFrame(rows[:1], kind)
    first = streams.first_in_order(streams.read_stream(spark, source, df.schema, files_per_trigger=1), "at", "10 days", ["place"])
    held = streams.run_available(first, target, state)["stateOperators"][0]["numRowsTotal"]
    assert held == 41
    end = [("END", "2025-01-01 00:00:00", 0, 0), ("C1", "2024-01-01 00:00:00", -1, 0)]
    spark.createDataFrame(end[:1], kind).coalesce(1).write.mode("append").parquet(source)
    left = streams.run_available(first, target, state)["stateOperators"][0]["numRowsTotal"]
    assert left == 1  # the last row alone: all others have been emitted
    spark.createDataFrame(end[1:], kind).coalesce(1).write.mode("append").parquet(source)
    streams.run_available(first, target, state)  # far too late: its session has been emitted
    found = {r["Container_ID"]: r["place"] for r in spark.read.parquet(target).collect()}
    expected = {}
    for name, _, place, _ in rows:
        expected[name] = min(place, expected.get(name, place))
    assert found == expected


def test_a_batch_that_fails_half_way_is_stored_once(spark, cleaned, tmp_path):
    from cargolens.operators.scoring import to_predictions

    store = BatchStore(spark, str(tmp_path / "store"))
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    cleaned.repartition(3).write.parquet(source)
    profile = fit_profile(with_measures(cleaned))
    profile.medians = {}

    def arriving():
        return streams.read_stream(spark, source, cleaned.schema, files_per_trigger=1)

    def score(batch):
        return streams.score_stream(batch, profile, rule_scores)

    real, calls = store.commit, []

    def commit(batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(batch_id)

    store.commit = commit
    with pytest.raises(Exception, match="lost"):
        streams.store_batches(arriving(), score, store, "s", state)
    assert {r["batch_id"] for r in store.commits().collect()} == {"s-00000000"}
    streams.store_batches(arriving(), score, store, "s", state)  # goes on at the failed batch
    streams.store_batches(arriving(), score, store, "s", str(tmp_path / "fresh"))  # all committed: nothing changes
    assert calls == ["s-00000000", "s-00000001", "s-00000001", "s-00000002"]
    found = store.committed("s").drop("batch_id")
    expected = to_predictions(rule_scores(engineer_features(cleaned, profile)))
    assert sorted(found.collect()) == sorted(expected.select(found.columns).collect())
    assert store.committed("other").count() == 0
