import math

import pytest
from pyspark.sql import functions as F

from cargolens.constants import FEATURES, LEVELS
from cargolens.operators import cleaning, models
from cargolens.operators.features import engineer_features, with_measures
from cargolens.operators.forest import draw_rows, fit_forest, isolation_score, mean_path, scaled_anomaly
from cargolens.operators.metrics import cross_entropy
from cargolens.operators.profile import fit_profile
from cargolens.operators.scoring import to_predictions
from cargolens.plans import derived, jobs
from cargolens.plans.staging import Staging
from cargolens.plans.testtables import ORDER, rule_scores, shipments
from cargolens.sources.sinks import write_csv
from cargolens.sources.store import BatchStore, ModelStore
from cargolens.streaming import streams


@pytest.fixture(scope="module")
def cleaned(spark, small):
    return derived.cleaned(spark, small)


@pytest.fixture(scope="module")
def run(spark, small):
    return jobs.train_model(shipments(spark, small), ORDER, rules="retrain", max_iter=4, trees=30)


def test_training_statistics(run):
    stats = run.model.stats
    assert stats["auc"] > 0.95 and stats["n_features"] == 32
    assert stats["train_size"] > 3 * stats["test_size"] > 0
    assert run.profile.anomaly_bounds[0] < run.profile.anomaly_bounds[1]
    assert run.report["label_column"] == "heuristic_generated"


def test_save_load_and_pointer(spark, run, cleaned, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    first, second = (store.save(run.model, run.profile) for _ in range(2))
    assert store.current() == second
    store.make_current(first)
    assert store.current() == first
    model, frozen = store.load()
    rows = engineer_features(cleaned, frozen)
    names = ["Container_ID", "classifier_score", "anomaly_score"]
    a = models.predict_scores(rows, run.model, run.profile.anomaly_bounds).select(names)
    b = models.predict_scores(rows, model, frozen.anomaly_bounds).select(names)
    assert sorted(a.collect()) == sorted(b.collect())


def test_score_batch(spark, run, small, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    batch = jobs.score_table(shipments(spark, small), ORDER, run.model, store, batch_id="b")
    rows = store.predictions(batch)
    total = store.cleaned(batch).count()
    assert rows.count() == total
    wrong = rows.where(
        ~F.col("risk_score").between(0, 100) | ~F.col("confidence").between(0, 1) | ~F.col("risk_level").isin(LEVELS)
    )
    assert wrong.count() == 0
    summary = store.summary(batch).first()
    assert summary["total_containers"] == total == sum(summary["risk_distribution"].values())
    assert store.statuses(batch).agg(F.sum("n")).first()[0] == total
    counters = store.accounting(batch).first()
    assert counters["rows_valid"] == total
    assert store.rejects(batch).agg(F.sum("copies")).first()[0] == counters["rows_failed"]
    assert rows.agg(F.max("anomaly_score")).first()[0] == 1.0


def test_evaluate(spark, run, small):
    with Staging(spark) as staging:
        report, rows = jobs.evaluate(shipments(spark, small), ORDER, run.model, label="Clearance_Status", staging=staging)
        found, counted = report.first(), rows.count()
    assert found["rows_after_cleaning"] == counted == sum(found["confusion_matrix"])
    assert found["total_rows"] == found["rows_with_valid_labels"] + found["rows_without_valid_labels"]
    assert 0 <= found["roc_auc"] <= 1
    with pytest.raises(ValueError):
        jobs.evaluate(shipments(spark, small), ORDER, run.model, label="none")


def test_single_records(spark, run):
    record = {
        "container_id": "N1", "declaration_date": "2024-01-06", "declaration_time": "23:10", "trade_regime": "Import",
        "origin_country": "KP", "destination_country": "US", "destination_port": "PORT_10", "hs_code": "271000",
        "importer_id": "I", "exporter_id": "E", "declared_value": 5000, "declared_weight": 100, "measured_weight": 170,
        "shipping_line": "Brand#1", "dwell_time_hours": 30,
    }
    batch = jobs.score_records(spark, [record], run.model).first()
    assert batch["anomaly_score"] == 1.0 and "70.0% higher" in batch["explanation"]
    frozen = jobs.score_records(spark, [record], run.model, profile=run.profile).first()
    assert frozen["container_id"] == "N1" and 0 <= frozen["anomaly_score"] <= 1
    with pytest.raises(ValueError):
        jobs.score_records(spark, [{**record, "declared_weight": "heavy"}], run.model)


def test_prepare_files(spark, small, tmp_path):
    write_csv(shipments(spark, small).drop(*ORDER), str(tmp_path / "in"))
    jobs.prepare_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert out.count() == shipments(spark, small).count()
    assert {r[0] for r in out.select("is_risky").distinct().collect()} == {"0", "1"}


@pytest.fixture(scope="module")
def points(spark):
    """Random points around 0 with ten far away; the label follows the first coordinate."""
    base = spark.range(1500).select(F.col("id").cast("string").alias("Container_ID"), *[F.randn(i).alias(f"f{i}") for i in range(4)])
    far = F.col("Container_ID").cast("int") < 10
    moved = base.withColumns({f"f{i}": F.when(far, F.lit(9.0) + F.col(f"f{i}")).otherwise(F.col(f"f{i}")) for i in range(4)})
    return moved.withColumn("label", (F.col("f0") > 0).cast("int")).cache()


def test_forest_finds_far_points(points):
    names = [f"f{i}" for i in range(4)]
    forest = fit_forest(points, names, trees=50, sample=128)
    raw = points.select("Container_ID", isolation_score(forest).alias("s")).cache()
    best = {r[0] for r in raw.orderBy(F.desc("s")).limit(10).collect()}
    assert len(best & {str(i) for i in range(10)}) >= 9
    again = fit_forest(points.repartition(5), names, trees=50, sample=128)
    assert sorted(map(tuple, again.nodes.collect())) == sorted(map(tuple, forest.nodes.collect()))
    sizes = forest.nodes.groupBy("tree").agg(F.count("*").alias("n"))
    assert sizes.count() == 50 and sizes.agg(F.max("n")).first()[0] <= 255
    scaled = raw.select(scaled_anomaly(F.col("s"), (0.2, 0.2)))
    assert scaled.where("NOT (`" + scaled.columns[0] + "` BETWEEN 0 AND 1)").count() == 0


def test_forest_draws_from_the_whole_table(spark):
    """A large table is not thinned: the drawn rows come from all over it."""
    rows = spark.range(500_000).select(
        F.col("id").cast("string").alias("Container_ID"), F.col("id").cast("double").alias("f0")
    )
    values = F.array(F.col("f0"))
    drawn = draw_rows(rows, "Container_ID", 100, 256, 42, values).select(F.col("x")[0].alias("v"))
    tenths = drawn.groupBy(F.floor(F.col("v") / 50_000)).count().collect()
    assert len(tenths) == 10 and min(r["count"] for r in tenths) > 3000
    assert drawn.distinct().count() > 30_000


def test_mean_path():
    assert mean_path(1) == 0 and mean_path(2) == 1
    assert abs(mean_path(256) - 10.244770920) < 1e-6


def test_logistic(points):
    names = [f"f{i}" for i in range(4)]
    rows = models.with_class_weight(points, models.balanced_weights(points))
    fitted = models.logistic(names, max_iter=30).fit(rows)
    losses = models.loss_history(fitted)
    assert losses[-1] < losses[0] and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    model = models.RiskModel(fitted, None, names)
    scored = models.classifier_scores(points, model)
    assert scored.where((F.col("classifier_score") >= 0.5).cast("int") != F.col("label")).count() < 30
    assert cross_entropy(scored, "label", "classifier_score").first()[0] < 0.2
    z = points.limit(1).select(models.sigmoid_score({"f0": 2.0}, 0.5).alias("p"), "f0").first()
    assert abs(z["p"] - 1 / (1 + math.exp(-(2 * z["f0"] + 0.5)))) < 1e-12


def test_split_is_stratified_and_stable(points):
    a, b = models.split(points)
    assert a.count() + b.count() == 1500 and a.join(b, "Container_ID").count() == 0
    shares = [b.where(F.col("label") == v).count() / points.where(F.col("label") == v).count() for v in (0, 1)]
    assert all(0.15 < s < 0.25 for s in shares)
    assert sorted(b.collect()) == sorted(models.split(points.repartition(7))[1].collect())


def test_feature_matrix_has_no_gaps(points):
    holes = points.withColumn("f1", F.lit(None).cast("double"))
    assert models.feature_matrix(holes, ["f0", "f1"]).where("f1 = 0").count() == 1500


def test_stream_equals_batch(spark, small, cleaned, tmp_path):
    unique = derived.unique(spark, small)
    source = str(tmp_path / "in")
    unique.repartition(4).write.parquet(source)
    fitted = fit_profile(with_measures(cleaned))
    fitted.medians = cleaning.unique_medians(unique)
    arriving = streams.read_stream(spark, source, unique.schema, files_per_trigger=1)
    assert arriving.isStreaming
    streams.run_available(
        streams.score_stream(arriving, fitted, rule_scores), str(tmp_path / "out"), str(tmp_path / "state"), 300
    )
    batch = to_predictions(rule_scores(engineer_features(cleaned)))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())


def test_stream_with_model(spark, run, small, tmp_path):
    rows = derived.unique(spark, small)
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), rows.schema)
    scored = streams.score_stream(stream, run.profile, streams.model_scorer(run.model, run.profile))
    streams.run_available(scored, str(tmp_path / "out"), str(tmp_path / "state"), 300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == derived.cleaned(spark, small).count()


def test_stream_duplicates_and_windows(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "2024-01-01 01:00:00", 80.0), ("a", "2024-01-01 02:00:00", 10.0), ("b", "2024-01-02 01:00:00", 30.0), ("c", "2024-01-09 01:00:00", 60.0)],
        "Container_ID string, t string, risk_score double",
    ).select("Container_ID", F.col("t").cast("timestamp").alias("ts"), "risk_score",
             F.when(F.col("risk_score") >= 75, "Critical").when(F.col("risk_score") >= 25, "Medium").otherwise("Low").alias("risk_level"))
    rows.write.parquet(str(tmp_path / "in"))

    def arriving():
        return streams.read_stream(spark, str(tmp_path / "in"), rows.schema)

    streams.run_available(streams.first_per_container(arriving(), "ts", "30 days"), str(tmp_path / "a"), str(tmp_path / "sa"), 300)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "a")).select("Container_ID").collect()) == ["a", "b", "c"]
    streams.run_available(streams.level_windows(arriving(), "ts"), str(tmp_path / "b"), str(tmp_path / "sb"), 300)
    days = spark.read.parquet(str(tmp_path / "b")).orderBy("window_start").collect()
    assert [(d["n"], d["critical"], d["medium"], d["low"], d["avg_score"]) for d in days] == [(2, 1, 0, 1, 45.0), (1, 0, 1, 0, 30.0)]


def test_features_are_all_numeric(cleaned):
    kinds = dict(engineer_features(cleaned).select(*FEATURES).dtypes)
    assert set(kinds.values()) <= {"double", "int", "bigint"}
