import random

import pytest
from pyspark.sql import functions as F

from cargolens import constants as K
from cargolens.functions.columns import fixed
from cargolens.operators import explain, labels, metrics, reports, scoring

SCORED = "id string, score double, level string, origin string, port string, value double, dw double, mw double, dwell double, hs string, line string, expl string, date string, anomaly_score double"


def level_of(score):
    return "Critical" if score >= 75 else "High" if score >= 50 else "Medium" if score >= 25 else "Low"


@pytest.fixture(scope="module")
def rows():
    """600 rows; a third share one score, and two thirds one origin and line."""
    draw = random.Random(3)
    out = []
    for i in range(600):
        score = 80.0 if i % 3 == 0 else round(draw.uniform(0, 100), 1)
        place = draw.choice(["US", "CN", "KP", "N/A"]) if i % 3 == 1 else "IR"
        out.append((f"C{i:04}", score, level_of(score), place, f"P{i % 4}", float(i), float(i % 7), float(i % 5), float(i % 150),
                    f"{27 + i % 3}00", "N/A" if i % 10 == 0 else f"L{i % 12}", 'say "x"', f"2020-01-{1 + i % 20:02}", (i % 11) / 10))
    return out


@pytest.fixture(scope="module")
def scored(spark, rows):
    return spark.createDataFrame(rows, SCORED).repartition(5).cache()


def ordered(rows):
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def test_blend_and_levels(spark):
    df = spark.createDataFrame([(0.8, 0.6)], "c double, a double")
    blend = df.select(scoring.risk_score(F.col("c"), F.col("a"))).first()[0]
    assert abs(blend - 0.74) < 1e-12
    assert scoring.blend_weights(2, 6) == (0.25, 0.75)
    for wrong in [(-1, 1), (0, 0)]:
        with pytest.raises(ValueError):
            scoring.blend_weights(*wrong)
    levels = spark.createDataFrame([(v,) for v in (0.9, 0.75, 0.6, 0.5, 0.4, 0.25, 0.1)], "s double")
    assert [r[0] for r in levels.select(scoring.risk_level(F.col("s"))).collect()] == [
        "Critical", "Critical", "High", "High", "Medium", "Medium", "Low"]


def test_number_texts(spark):
    values = [0.0, 2.5, 3.5, 20.25, 1234567.5, 0.125, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(fixed(F.col("v"), 0), fixed(F.col("v"), 0, grouping=True), fixed(F.col("v"), 1), fixed(F.col("v"), 2)).collect()
    for v, row in zip(values, got):
        assert list(row)[:2] == [f"{v:.0f}", f"{v:,.0f}"]
        assert row[3] == f"{v:.2f}"
    assert [r[2] for r in got[:4]] == [f"{v:.1f}" for v in values[:4]]


EXPLAINED = "weight_diff_pct double, value_per_kg double, flag_high_value_density int, flag_low_value_density int, origin_country_risk int, dest_country_risk int, route_frequency long, Dwell_Time_Hours double, flag_excessive_dwell int, flag_minimal_dwell int, is_night int, is_weekend int, HS_Code string, risk_level string, score double"


def test_explanations(spark):
    quiet = (0.0, 10.0, 0, 0, 0, 0, 5, 24.0, 0, 0, 0, 0, "1000")
    loud = (-25.04, 12345.6, 1, 0, 2, 2, 1, 400.5, 1, 0, 1, 1, "2710")
    df = spark.createDataFrame(
        [(*quiet, "Low", 0.125), (*loud, "Critical", 0.9), (*loud, "High", 0.6), (*loud, "Low", 0.1),
         (*quiet[:2], 0, 1, 1, 0, 5, 0.5, 0, 1, 0, 1, "8400", "Medium", 0.3)],
        EXPLAINED,
    )
    got = [r[0] for r in df.select(explain.explanation()).collect()]
    weight = "Measured weight is 25.0% lower than declared."
    value = "Exceptionally high value density ($12,346/kg) - possible luxury or contraband goods."
    assert got == [
        "All parameters within normal ranges. Risk score: 0.12. Standard processing.",
        f"{weight} {value}", weight, f"Minor risk indicators noted: {weight}; {value}.",
        "Suspiciously low value density ($10.00/kg) - possible undervaluation or commodity fraud.",
    ]
    parts = df.select(explain.route_text(), explain.dwell_text(), explain.timing_text(), explain.hs_text()).collect()
    assert parts[1][0] == "Route factors: high-risk origin country, high-risk destination, infrequent or unusual trade route."
    assert parts[1][1].startswith("Excessive port dwell time (400 hours)")
    assert parts[1][2] == "Timing flags: submitted during off-hours, weekend submission (may indicate avoidance of oversight)."
    assert parts[1][3] == "HS code 27** associated with controlled/restricted commodities."
    assert parts[4][0] == "Route factors: medium-risk origin country."
    assert parts[4][1].startswith("Unusually rapid clearance (0 hours)")


def test_label_words(spark):
    words = ["1", "0", "Critical", "Low Risk", " Clear", "Flagged", "UNKNOWN_LABEL", "", None, "very high", "safe-ish"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[1] for r in labels.normalize_labels(df, "w").collect()] == [1, 0, 1, 0, 0, 1, None, None, None, 1, 0]
    numbers = spark.createDataFrame([(2.5,), (0.0,), (float("nan"),), (None,)], "w double")
    assert [r[1] for r in labels.normalize_labels(numbers, "w").collect()] == [1, 0, None, None]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "w boolean")
    assert [r[1] for r in labels.normalize_labels(flags, "w").collect()] == [1, 0, None]
    coerced = spark.createDataFrame([("1",), ("x",), ("2.7",), (None,)], "w string")
    assert [r[1] for r in labels.numeric_labels(coerced, "w").collect()] == [1, 0, 2, 0]


def test_single_class_guard(spark):
    df = spark.range(503).select(F.col("id").cast("string").alias("Container_ID"), F.lit(0).alias("label"))
    flipped = labels.guard_single_class(df, "label")
    assert flipped.agg(F.sum("label")).first()[0] == 50
    assert sorted(flipped.collect()) == sorted(labels.guard_single_class(df.repartition(3), "label").collect())
    mixed = df.withColumn("label", (F.col("Container_ID") == "7").cast("int"))
    assert labels.guard_single_class(mixed, "label").agg(F.sum("label")).first()[0] == 1
    one = labels.guard_single_class(df.limit(1), "label")
    assert one.first()["label"] == 1


def test_summary_and_groups(spark):
    df = spark.createDataFrame(
        [("a", 90.0, "Critical", 0.9), ("b", 60.0, "High", 0.8), ("c", 10.0, "Low", 0.1)],
        "id string, score double, level string, anomaly_score double",
    )
    s = reports.summary(df).first()
    assert [s[c] for c in ("critical", "high", "medium", "low", "anomalies")] == [1, 1, 0, 1, 2]
    assert reports.summary(df.limit(0)).first()["average_risk_score"] == 0.0
    assert [r["n"] for r in reports.group_sizes(df).orderBy("level_order").collect()] == [1, 1, 0, 1]
    odd = df.withColumn("level", F.lit("Odd"))
    assert reports.group_by_level(odd).count() == 0


def test_rank_and_neighbours(scored, rows):
    best = ordered(rows)
    ranks = {r["id"]: r["rank"] for r in reports.rank_all(scored).collect()}
    assert ranks == {r[0]: i + 1 for i, r in enumerate(best)}
    beside = {r["id"]: (r["prev_id"], r["next_id"]) for r in reports.neighbours_all(scored).collect()}
    ids = [None, *[r[0] for r in best], None]
    assert beside == {ids[i]: (ids[i - 1], ids[i + 1]) for i in range(1, len(ids) - 1)}
    for i in (0, 77, 599):
        container = best[i][0]
        assert reports.rank_of(scored, container).first()["rank"] == i + 1
        one = reports.neighbours_of(scored, container).first()
        assert (one["prev_id"], one["next_id"]) == (ids[i], ids[i + 2])
    assert reports.rank_of(scored, "none").first()["rank"] == 0


def test_peers(scored, rows):
    best = ordered(rows)
    wanted = {}
    for r in rows:
        if r[2] != "Low":
            same = [b[0] for b in best if b[0] != r[0] and (b[3], b[2]) == (r[3], r[2])]
            wanted[r[0]] = same[:5]
    got = {}
    for r in reports.peers_all(scored).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["peer_id"])
    assert got == {k: v for k, v in wanted.items() if v}
    example = best[3][0]
    assert [r["id"] for r in reports.peers_of(scored, example).collect()] == wanted[example]
    low = next(r[0] for r in rows if r[2] == "Low")
    assert reports.peers_of(scored, low).count() == 0


def test_pages(scored, rows):
    best = [r[0] for r in ordered(rows)]
    assert [r["id"] for r in reports.page(scored, 30).collect()] == best[580:]
    last = ordered(rows)[19]
    assert [r["id"] for r in reports.page_after(scored, last[1], last[0]).collect()] == best[20:40]
    assert tuple(reports.page_count(scored).first()) == (600, 30)
    with pytest.raises(ValueError):
        reports.sort_by(scored, "odd")


def test_search_and_filters(scored, rows):
    assert reports.search(scored, "").count() == 600
    assert reports.search(scored, "c001").count() == sum("C001" in r[0] for r in rows)
    assert reports.search(scored, "270").count() == sum("270" in r[9] or "270" in r[0] for r in rows)
    assert reports.filter_level(scored, "All").count() == 600
    assert reports.filter_level(scored, "Low").count() == sum(r[2] == "Low" for r in rows)


def test_charts(scored, rows):
    bars = {r["bucket"]: r["n"] for r in reports.score_histogram(scored).collect()}
    assert bars == {b: sum(min(9, int(r[1] // 10)) == b for r in rows) for b in range(10)}
    names = {r["name"] for r in reports.line_breakdown(scored).collect()}
    assert "N/A" not in names and len(names) == 8
    radar = {(r["id"], r["factor"]): r["value"] for r in reports.radar(scored).collect()}
    assert len(radar) == 3000 and radar["C0000", "Weight gap"] == 0.0 and radar["C0000", "Origin Risk"] == 90.0
    shown = {r["id"]: r for r in reports.display_metrics(scored).collect()}
    assert shown["C0000"]["value_per_kg"] is None and shown["C0000"]["odd_dwell"] == 1
    days = reports.daily_trend(scored).orderBy("date").collect()
    assert days[0]["change"] is None and sum(d["n"] for d in days) == 600


def test_attach_defaults_and_last_row(spark):
    predictions = spark.createDataFrame(
        [("a", 50.0, "High", "t", 0.5, 0.5, 0.1), ("gone", 1.0, "Low", None, 0.1, 0.1, 0.1)],
        "container_id string, risk_score double, risk_level string, explanation_summary string, confidence double, classifier_score double, anomaly_score double",
    )
    raw = spark.createDataFrame(
        [(" a", "US", "5", 1), ("a ", None, "x", 2), ("", "CN", "1", 3)], "Container_ID string, Origin_Country string, Declared_Value string, seq int"
    )
    first = {r["id"]: r for r in reports.attach_attributes(predictions, raw, order_cols=["seq"]).collect()}
    assert (first["a"]["origin"], first["a"]["value"]) == ("US", 5.0)
    assert (first["gone"]["origin"], first["gone"]["expl"], first["gone"]["dw"]) == ("N/A", K.TEXT_NO_EXPLANATION, 0.0)
    last = {r["id"]: r for r in reports.attach_attributes(predictions, raw, keep="last", order_cols=["seq"]).collect()}
    assert (last["a"]["origin"], last["a"]["value"]) == ("N/A", 0.0)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    draw = random.Random(5)
    pairs = [(draw.randint(0, 1), 0.5 if draw.random() < 0.4 else round(draw.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "label int, score double")
    assert abs(metrics.roc_auc(df).first()[0] - brute_auc(pairs)) < 1e-12
    only = metrics.roc_auc(df.where("label = 1")).first()[0]
    assert only != only


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 1 + [(0, 0)] * 11, "label int, prediction int")
    m = metrics.binary_metrics(df).first()
    assert (m["true_positive"], m["false_negative"], m["false_positive"], m["true_negative"]) == (6, 2, 1, 11)
    assert abs(m["accuracy"] - 0.85) < 1e-12 and abs(m["precision"] - 6 / 7) < 1e-12 and m["recall"] == 0.75
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert report["0"]["support"] == 12 and abs(report["macro avg"]["recall"] - (0.75 + 11 / 12) / 2) < 1e-12
    assert abs(report["weighted avg"]["precision"] - (12 * 11 / 13 + 8 * 6 / 7) / 20) < 1e-12
    empty = metrics.binary_metrics(df.where("label = 0 AND prediction = 0")).first()
    assert empty["precision"] == 0.0 and empty["accuracy"] == 1.0
    with pytest.raises(ValueError):
        metrics.predict_at(df.withColumn("score", F.lit(0.5)), 1.5)
