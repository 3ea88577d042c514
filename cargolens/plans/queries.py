"""The registered queries: one per operator, over the driver's tables.

``QUERIES`` maps a name to a callable (spark, sf_dir) -> DataFrame and ``ORACLE`` maps the same
name to SQL where plain SQL can express the operator. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens import constants as K
from cargolens.functions.columns import col, to_double
from cargolens.operators import cleaning, explain, labels, metrics, models, profile, reports, scoring
from cargolens.operators import features as feature_ops
from cargolens.operators.descent import fit_descent
from cargolens.operators.forest import fit_forest, isolation_score, max_depth, scaled_anomaly, score_bounds
from cargolens.operators.profile_state import RANK_ERROR, ProfileLog
from cargolens.plans import derived, jobs
from cargolens.plans.oracle import STEPS, sql
from cargolens.plans.staging import freed_shuffles, stage, stage_path
from cargolens.plans.testtables import ORDER, rule_columns, rule_scores, shipments
from cargolens.schema import missing_fields, normalize_columns
from cargolens.sources import csv as csv_source
from cargolens.sources import sinks
from cargolens.sources.indexed import BucketedStore, RankIndex
from cargolens.sources.store import BatchStore, ModelStore
from cargolens.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under its operator's id and, where there is one, its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add


_CELLS = ["true_negative", "false_positive", "false_negative", "true_positive"]
#: The draw of the train/test split and of the label guard, in SQL.
_DRAW_SQL = "CAST('0x' || substr(md5(Container_ID || ':42'), 1, 15) AS BIGINT)"
_PART_SQL = f"CASE WHEN {_DRAW_SQL} / CAST(1152921504606846976 AS DOUBLE) < 0.2 THEN 'test' ELSE 'train' END"
_RETRAIN_SQL = (
    "CAST(abs(weight_diff_pct) > 20 OR flag_high_value_density = 1"
    " OR origin_country_risk = 2 OR dest_country_risk = 2 OR flag_excessive_dwell = 1 AS INT)"
)


#: Rows and labels on each side of the split: what a fit's report must agree with.
_SIDES_SQL = f"""count(*) FILTER (WHERE {_PART_SQL} = 'train') AS train_rows,
  count(*) FILTER (WHERE {_PART_SQL} = 'test') AS test_rows,
  count(*) FILTER (WHERE {_PART_SQL} = 'test' AND {_RETRAIN_SQL} = 1) AS test_risky"""


# --- output helpers ---------------------------------------------------------------------


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable form: doubles rounded, dates as text, counts as bigint stay."""
    out = []
    for name, kind in df.dtypes:
        c = col(name)
        if kind == "double":
            c = F.round(c, digits)
        elif kind in ("date", "timestamp"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


SHIP_COLUMNS = K.REQUIRED_COLUMNS + ["Clearance_Status"]


def _ship_out(df: DataFrame, columns=SHIP_COLUMNS) -> DataFrame:
    return rounded(df.select(*columns), 4)


def _ship_sql(columns=SHIP_COLUMNS) -> str:
    out = []
    for c in columns:
        if c in K.MEASURES:
            out.append(f"round({c}, 4) AS {c}")
        elif c == "Declaration_Date":
            out.append(f"CAST({c} AS VARCHAR) AS {c}")
        else:
            out.append(c)
    return "SELECT " + ", ".join(out)


SCORED_COLUMNS = {
    "id": 0, "score": 1, "level": 0, "origin": 0, "port": 0, "value": 1, "dw": 1, "mw": 1,
    "dwell": 1, "hs": 0, "line": 0, "expl": 0, "date": 0, "confidence": 1, "classifier_score": 1,
    "anomaly_score": 1,
}


def _scored_sql(columns=tuple(SCORED_COLUMNS)) -> str:
    return "SELECT " + ", ".join(
        f"round({c}, 6) AS {c}" if SCORED_COLUMNS[c] else c for c in columns
    )


LISTED = ("id", "score", "level", "origin", "value", "dwell")


def _listed(df: DataFrame) -> DataFrame:
    return rounded(df.select(*LISTED))


PREDICTION_SQL = """SELECT Container_ID AS container_id, round(score * 100, 6) AS risk_score, risk_level,
  explanation_summary, round(greatest(classifier_score, anomaly_score), 6) AS confidence,
  round(classifier_score, 6) AS classifier_score, round(anomaly_score, 6) AS anomaly_score FROM explained"""


# --- S: sources and sinks ---------------------------------------------------------------


def _raw(spark, sf_dir) -> DataFrame:
    return shipments(spark, sf_dir).select(*SHIP_COLUMNS)


@query("s1_csv_scan", sql("ships", _ship_sql() + " FROM ships"))
def s1(spark, sf_dir):
    path = stage_path(spark, "s1")
    sinks.write_csv(_raw(spark, sf_dir), path)
    return _ship_out(cleaning.standardize(csv_source.read_csv(spark, path)))


@query("s2_defensive_csv", sql("ships", _ship_sql(K.REQUIRED_COLUMNS) + " FROM ships"))
def s2(spark, sf_dir):
    path = stage_path(spark, "s2")
    raw = shipments(spark, sf_dir).select(*K.REQUIRED_COLUMNS)
    # two columns too many, without name or content, and a BOM before the header
    empty = F.lit(None).cast("string")
    untidy = raw.withColumns({" ": empty, "  ": empty}).withColumnRenamed(
        "Container_ID", "\ufeffContainer_ID"
    )
    untidy.write.option("header", True).option("emptyValue", "").csv(path)
    return _ship_out(cleaning.standardize(csv_source.read_uploaded_csv(spark, path)), K.REQUIRED_COLUMNS)


_BROKEN_SQL = """Shipping_Line || chr(10) || chr(10) || '"' || Destination_Port || '",' || chr(10)
  || CASE WHEN length(Container_ID) % 3 = 0 THEN '' ELSE 'end, ""' END"""


@query(
    "s2_quoted_line_breaks",
    sql("ships", f"SELECT Container_ID, {_BROKEN_SQL} AS Shipping_Line, HS_Code, round(Declared_Value, 4) AS Declared_Value FROM ships").replace(
        "|| '\",' ||", "|| '\"' ||"  # empty fields at the end of a line go, also inside a cell
    ),
)
def s2_breaks(spark, sf_dir):
    """Cells with line breaks, quotes and commas, in files that are cut every 64 KB, under two headers."""
    path = stage_path(spark, "s2b")
    raw = shipments(spark, sf_dir).select("Container_ID", F.expr(_BROKEN_SQL).alias("Shipping_Line"), "HS_Code", "Declared_Value")
    raw = stage(raw, "s2-rows")  # both halves read it
    odd = F.length("HS_Code") + F.ascii(F.substring("HS_Code", 6, 1)) % 2
    halves = (raw.where(odd == 6), raw.where(odd != 6).select("HS_Code", "Declared_Value", "Shipping_Line", "Container_ID"))
    for half in halves:
        writer = half.write.mode("append").options(header=True, escape='"', ignoreTrailingWhiteSpace=False)
        writer.csv(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        back = csv_source.read_uploaded_csv(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return rounded(
        back.select("Container_ID", "Shipping_Line", "HS_Code", to_double("Declared_Value").alias("Declared_Value")), 4
    )


@query("s3_header_mapping", sql("ships", _ship_sql() + " FROM ships"))
def s3(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    untidy = raw.toDF(*[f"\ufeff {c.upper().replace('_', '-')} (note)" if c in K.REQUIRED_COLUMNS else c
                        for c in raw.columns])
    return _ship_out(normalize_columns(untidy))


@query("s4_history_renames", sql("ships", _ship_sql() + " FROM ships"))
def s4(spark, sf_dir):
    old = {new: name for name, new in K.HISTORY_RENAMES.items()}
    raw = _raw(spark, sf_dir).withColumnsRenamed(old)
    return _ship_out(csv_source.rename_history(raw))


@query(
    "s6_labelled_csv",
    sql("ships", "SELECT Container_ID, is_risky, count(*) AS n FROM (SELECT Container_ID, CAST("
        "coalesce(Origin_Country IN ('KP','IR','NG','PK','SY','LB','MY','TH'), FALSE)"
        " OR coalesce(abs(Measured_Weight - Declared_Weight) / (Declared_Weight + 1e-9) * 100 > 50, FALSE)"
        " OR coalesce(Dwell_Time_Hours > 100, FALSE)"
        " OR coalesce(Clearance_Status IN ('Flagged','Seized','Rejected','Held','Under Review'), FALSE)"
        " OR coalesce(Declared_Value > 100000, FALSE) AS INT) AS is_risky FROM ships) GROUP BY 1, 2"),
)
def s6(spark, sf_dir):
    path = stage_path(spark, "s6")
    sinks.write_csv(jobs.prepare_history(_raw(spark, sf_dir)), path)
    back = labels.numeric_labels(csv_source.read_csv(spark, path), "is_risky", "is_risky")
    return back.groupBy("Container_ID", "is_risky").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_evaluation_csv",
    sql("judged", "SELECT Container_ID AS container_id, label AS actual_label, prediction AS predicted_label,"
        " round(score * 100, 4) AS risk_score, risk_level, CAST(label = prediction AS INT) AS is_correct FROM judged"),
)
def s7(spark, sf_dir):
    path = stage_path(spark, "s7")
    sinks.write_csv(metrics.evaluation_rows(derived.judged(spark, sf_dir)), path)
    back = csv_source.read_csv(spark, path)
    whole = ["actual_label", "predicted_label", "is_correct"]
    return back.select(
        "container_id", *[col(c).cast("int").alias(c) for c in whole],
        col("risk_score").cast("double").alias("risk_score"), "risk_level",
    )


@query(
    "s8_predictions_export",
    sql("explained", "SELECT Container_ID, round(score * 100, 2) AS Risk_Score, risk_level AS Risk_Level,"
        " explanation_summary AS Explanation FROM explained"),
)
def s8(spark, sf_dir):
    path = stage_path(spark, "s8")
    sinks.write_csv(sinks.predictions_export(derived.predictions(spark, sf_dir)), path)
    back = csv_source.read_csv(spark, path)
    return back.select(
        "Container_ID", col("Risk_Score").cast("double").alias("Risk_Score"), "Risk_Level", "Explanation"
    )


_REPORT_SQL = """SELECT id AS Container_ID, round(score, 6) AS Risk_Score, level AS Risk_Level,
  origin AS Origin_Country, round(value, 4) AS Declared_Value, round(dw, 4) AS Declared_Weight,
  round(mw, 4) AS Measured_Weight, round(dwell, 4) AS Dwell_Time_Hours, hs AS HS_Code,
  line AS Shipping_Line, replace(expl, '"', '''') AS Explanation_Summary FROM scored"""


@query("s9_report_export", sql("scored", _REPORT_SQL))
def s9(spark, sf_dir):
    path = stage_path(spark, "s9")
    sinks.write_csv(sinks.report_export(derived.scored(spark, sf_dir)), path)
    back = csv_source.read_csv(spark, path).select(*K.REPORT_COLUMNS)
    back = back.withColumns({c: to_double(c) for c in ["Risk_Score", *K.MEASURES]})
    return rounded(back).withColumns({c: F.round(c, 4) for c in K.MEASURES})


@query("s10_canonical_csv", sql("ships", _ship_sql() + " FROM ships"))
def s10(spark, sf_dir):
    path = stage_path(spark, "s10")
    sinks.write_canonical_csv(_raw(spark, sf_dir), path)
    return _ship_out(cleaning.standardize(csv_source.read_uploaded_csv(spark, path)))


@query(
    "s11_scored_csv",
    sql("scored", _scored_sql(("id", "score", "level", "origin", "value", "dw", "mw", "dwell", "hs", "line",
                               "expl")) + ", '' AS date FROM scored"),
)
def s11(spark, sf_dir):
    path = stage_path(spark, "s11")
    sinks.write_csv(sinks.report_export(derived.scored(spark, sf_dir)), path)
    return rounded(csv_source.read_scored_csv(spark, path))


@query(
    "s12_training_report",
    sql("feats", f"""SELECT 'heuristic_generated' AS label_column, count(*) AS rows_after_cleaning,
  CAST({len(K.FEATURES)} AS BIGINT) AS feature_count, CAST(0.7 AS DOUBLE) AS classifier_weight, CAST(0.3 AS DOUBLE) AS anomaly_weight, {_SIDES_SQL} FROM feats"""),
)
def s12(spark, sf_dir):
    path = stage_path(spark, "s12")
    run = derived.trained(spark, sf_dir)
    sinks.write_report_json(spark.createDataFrame([jobs._report_row(run.report)]), path)
    report = spark.read.json(path)
    found, blend = col("validation_metrics"), col("risk_scorer_weights")
    risky = F.filter(found["report"], lambda x: x["class"] == "1")[0]["support"]
    return rounded(report.select(
        "label_column", "rows_after_cleaning", "feature_count",
        blend["classifier_weight"].alias("classifier_weight"), blend["anomaly_weight"].alias("anomaly_weight"),
        found["train_size"].alias("train_rows"), found["test_size"].alias("test_rows"), risky.alias("test_risky"),
    ))


_CELLS_SQL = """count(*) FILTER (WHERE label = 0 AND prediction = 0) AS true_negative,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS false_positive,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS false_negative,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS true_positive"""
_AUC_STEPS = (
    ("by_score", "SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg"
     " FROM judged GROUP BY score"),
    ("upto", "SELECT *, sum(neg) OVER (ORDER BY score) AS neg_upto FROM by_score"),
    ("auc", "SELECT sum(pos * (neg_upto - neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc FROM upto"),
    ("cells", f"SELECT {_CELLS_SQL} FROM judged"),
)
_METRIC_SQL = """round((true_positive + true_negative) / CAST(true_positive + true_negative + false_positive
    + false_negative AS DOUBLE), 6) AS accuracy,
  round(true_positive / CAST(true_positive + false_positive AS DOUBLE), 6) AS precision,
  round(true_positive / CAST(true_positive + false_negative AS DOUBLE), 6) AS recall,
  round(2 * true_positive / CAST(2 * true_positive + false_positive + false_negative AS DOUBLE), 6) AS f1_score"""


def _flat_report(report: DataFrame) -> DataFrame:
    flat = report.select(
        "total_rows", "rows_with_valid_labels", "rows_without_valid_labels", "rows_after_cleaning",
        "accuracy", "precision", "recall", "f1_score", "roc_auc",
        *[col("confusion_matrix")[c].alias(c) for c in _CELLS],
    )
    return rounded(flat)


@query(
    "s14_model_store",
    sql("cleaned", "SELECT Container_ID, TRUE AS in_range, TRUE AS same_classifier, TRUE AS same_anomaly FROM cleaned"),
)
def s14(spark, sf_dir):
    store = ModelStore(spark, stage_path(spark, "models"))
    run = derived.trained(spark, sf_dir)
    store.save(run.model, run.profile)
    model, frozen = store.load()
    rows = derived.cleaned(spark, sf_dir)
    names = ["Container_ID", "classifier_score", "anomaly_score"]
    stored = models.predict_scores(feature_ops.engineer_features(rows, frozen), model, frozen.anomaly_bounds)
    own = models.predict_scores(
        feature_ops.engineer_features(rows, run.profile), run.model, run.profile.anomaly_bounds
    ).select("Container_ID", col("classifier_score").alias("c"), col("anomaly_score").alias("a"))
    return stored.select(*names).join(own, "Container_ID").select(
        "Container_ID",
        (col("classifier_score").between(0, 1) & col("anomaly_score").between(0, 1)).alias("in_range"),
        (F.abs(col("classifier_score") - col("c")) < 1e-12).alias("same_classifier"),
        (F.abs(col("anomaly_score") - col("a")) < 1e-12).alias("same_anomaly"),
    )


@query(
    "s15_model_runs",
    "SELECT CAST(3 AS BIGINT) AS pointers, CAST(2 AS BIGINT) AS runs, 1 AS has_first, 1 AS has_second, 1 AS loads_first",
)
def s15(spark, sf_dir):
    store = ModelStore(spark, stage_path(spark, "models"))
    run = derived.trained(spark, sf_dir)
    first = store.save(run.model, run.profile)
    second = store.save(run.model, run.profile)
    store.make_current(first)
    runs = spark.read.parquet(f"{store.path}/current")
    return runs.groupBy().agg(
        F.count(F.lit(1)).alias("pointers"),
        F.count_distinct("run_id").alias("runs"),
        F.max((col("run_id") == first).cast("int")).alias("has_first"),
        F.max((col("run_id") == second).cast("int")).alias("has_second"),
        F.max_by((col("run_id") == first).cast("int"), "since").alias("loads_first"),
    )


@query("s16_batch_store", sql("explained", PREDICTION_SQL + " WHERE risk_level IN ('Critical', 'High')"))
def s16(spark, sf_dir):
    store = BatchStore(spark, stage_path(spark, "batches"))
    rows = derived.predictions(spark, sf_dir)
    for _ in range(2):  # the second write replaces the batch
        store.write_predictions(rows, "b1")
    both = store.by_level("b1", "Critical").unionByName(store.by_level("b1", "High"))
    return rounded(both)


# --- C: cleaning ------------------------------------------------------------------------


@query(
    "c1_schema_validation",
    "WITH ships AS (" + STEPS["ships"] + ") SELECT 'Missing required field: ' || f AS error, n AS row_count FROM"
    " (SELECT unnest(['HS_Code', 'Dwell_Time_Hours']) AS f), (SELECT count(*) AS n FROM ships)",
)
def c1(spark, sf_dir):
    partial = shipments(spark, sf_dir).drop("HS_Code", "Dwell_Time_Hours")
    errors = F.array(*[F.lit(e) for e in missing_fields(partial.columns)])
    return partial.agg(F.count(F.lit(1)).alias("row_count")).select(F.explode(errors).alias("error"), "row_count")


def _as_text(df: DataFrame) -> DataFrame:
    """All columns as text, with some cells that do not parse."""
    bad_date = F.when(col("k_part") % 11 == 0, F.lit("n/a-date")).otherwise(col("Declaration_Date").cast("string"))
    bad_value = F.when(col("k_part") % 13 == 0, F.lit("12,5x")).when(col("k_part") % 17 == 0, F.lit("NaN"))
    return df.select(
        *[col(c).cast("string").alias(c) for c in SHIP_COLUMNS if c not in ("Declaration_Date", "Declared_Value")],
        bad_date.alias("Declaration_Date (YYYY-MM-DD)"),
        bad_value.otherwise(col("Declared_Value").cast("string")).alias("Declared_Value"),
    )


@query(
    "c2_standardize",
    "WITH ships AS (" + STEPS["ships"] + "), bad AS (SELECT * REPLACE ("
    "CASE WHEN k_part % 11 = 0 THEN NULL ELSE Declaration_Date END AS Declaration_Date,"
    " CASE WHEN k_part % 13 = 0 OR k_part % 17 = 0 THEN NULL ELSE Declared_Value END AS Declared_Value) FROM ships) "
    + _ship_sql() + " FROM bad",
)
def c2(spark, sf_dir):
    return _ship_out(cleaning.standardize(_as_text(shipments(spark, sf_dir))))


@query("c3_deduplicate", sql("uniq", _ship_sql() + " FROM uniq"))
def c3(spark, sf_dir):
    return _ship_out(cleaning.remove_duplicates(shipments(spark, sf_dir), ORDER))


@query("c4_drop_missing", sql("complete", _ship_sql() + " FROM complete"))
def c4(spark, sf_dir):
    return _ship_out(cleaning.drop_missing_critical(derived.unique(spark, sf_dir)))


@query("c5_median_fill", sql("filled", "SELECT Container_ID, round(Dwell_Time_Hours, 6) AS Dwell_Time_Hours FROM filled"))
def c5(spark, sf_dir):
    rows = cleaning.drop_missing_critical(derived.unique(spark, sf_dir))
    filled = cleaning.fill_numeric(rows, cleaning.unique_medians(rows))
    return rounded(filled.select("Container_ID", "Dwell_Time_Hours"))


@query("c6_unknown_fill", sql("filled", "SELECT Container_ID, Origin_Country, Clearance_Status FROM filled"))
def c6(spark, sf_dir):
    rows = cleaning.drop_missing_critical(derived.unique(spark, sf_dir))
    return cleaning.fill_categorical(rows).select("Container_ID", "Origin_Country", "Clearance_Status")


@query(
    "c7_range_filter",
    sql("complete", "SELECT Container_ID, round(Dwell_Time_Hours, 6) AS Dwell_Time_Hours FROM complete WHERE "
        + " AND ".join(f"{c} BETWEEN {lo!r} AND {hi!r}" for c, (lo, hi) in K.RANGE_LIMITS.items())),
)
def c7(spark, sf_dir):
    rows = cleaning.filter_ranges(cleaning.drop_missing_critical(derived.unique(spark, sf_dir)))
    return rounded(rows.select("Container_ID", "Dwell_Time_Hours"))


@query("c8_clean", sql("cleaned", _ship_sql() + " FROM cleaned"))
def c8(spark, sf_dir):
    return _ship_out(cleaning.clean(shipments(spark, sf_dir), ORDER))


_REASON_SQL = "CASE WHEN rn > 1 THEN 'duplicate' WHEN NOT (" + " AND ".join(
    f"{c} IS NOT NULL" for c in K.CRITICAL_COLUMNS
) + ") THEN 'missing_critical' WHEN NOT (" + " AND ".join(
    (f"coalesce({c}, (SELECT m FROM med))" if c == "Dwell_Time_Hours" else c) + f" BETWEEN {lo!r} AND {hi!r}"
    for c, (lo, hi) in K.RANGE_LIMITS.items()
) + ") THEN 'invalid_range' END"


@query(
    "c9_row_accounting",
    sql("med", f"""SELECT 'success' AS status, count(*) AS rows_received,
  count(*) FILTER (WHERE reason IS NULL) AS rows_valid, count(*) FILTER (WHERE reason IS NOT NULL) AS rows_failed,
  count(*) FILTER (WHERE reason = 'duplicate') AS duplicates_removed,
  count(*) FILTER (WHERE reason = 'missing_critical') AS rows_with_missing_critical,
  count(*) FILTER (WHERE reason = 'invalid_range') AS invalid_value_ranges
  FROM (SELECT {_REASON_SQL} AS reason FROM ranked)"""),
)
def c9(spark, sf_dir):
    rows = shipments(spark, sf_dir)
    medians = cleaning.unique_medians(derived.unique(spark, sf_dir))
    return cleaning.row_accounting(rows, ORDER, medians)


@query(
    "c10_reject_reasons",
    sql("med", f"SELECT Container_ID, CAST(k_part AS BIGINT) AS k_part, CAST(k_supp AS BIGINT) AS k_supp,"
        f" round(k_price, 4) AS k_price, {_REASON_SQL} AS reject_reason, CAST(1 AS BIGINT) AS copies FROM ranked"),
)
def c10(spark, sf_dir):
    rows = shipments(spark, sf_dir)
    medians = cleaning.unique_medians(derived.unique(spark, sf_dir))
    out = cleaning.reject_reasons(rows, ORDER, medians, unique_order=True)
    return out.select("Container_ID", "k_part", "k_supp", r("k_price", 4).alias("k_price"), "reject_reason", "copies")


@query(
    "c11_preview",
    sql("ships", "SELECT count(*) AS total, count(DISTINCT Origin_Country) AS unique_origins,"
        " round(avg(coalesce(Declared_Value, 0)), 4) AS avg_value,"
        " round(avg(coalesce(Dwell_Time_Hours, 0)), 4) AS avg_dwell FROM ships"),
)
def c11(spark, sf_dir):
    return rounded(cleaning.preview(shipments(spark, sf_dir)), 4)


@query(
    "c11_preview_sample",
    sql("ships", _ship_sql() + " FROM (SELECT * FROM ships ORDER BY Container_ID, " + ", ".join(ORDER) + " LIMIT 3)"),
)
def c11_sample(spark, sf_dir):
    return _ship_out(cleaning.preview_sample(shipments(spark, sf_dir), ["Container_ID", *ORDER]))


@query(
    "c12_history_types",
    sql("ships", _ship_sql() + " FROM ships"),
)
def c12(spark, sf_dir):
    return _ship_out(cleaning.standardize_history(_raw(spark, sf_dir).withColumn(
        "Declared_Weight", col("Declared_Weight").cast("string"))))


_L5_SQL = """CASE WHEN t IN ({pos}) THEN 1 WHEN t IN ({neg}) THEN 0
  WHEN contains(t, 'critical') OR contains(t, 'high') OR contains(t, 'risky') THEN 1
  WHEN contains(t, 'low') OR contains(t, 'clear') OR contains(t, 'safe') THEN 0 END""".format(
    pos=", ".join(f"'{w}'" for w in K.POSITIVE_LABELS), neg=", ".join(f"'{w}'" for w in K.NEGATIVE_LABELS)
)


@query(
    "c13_readable_labels",
    sql("ships", "SELECT label, count(*) AS n FROM (SELECT " + _L5_SQL + " AS label FROM"
        " (SELECT lower(trim(Clearance_Status)) AS t FROM ships)) WHERE label IS NOT NULL GROUP BY 1"),
)
def c13(spark, sf_dir):
    rows = labels.normalize_labels(shipments(spark, sf_dir), "Clearance_Status")
    return labels.label_distribution(cleaning.readable_labels(rows, "label"), "label")


# --- F: features ------------------------------------------------------------------------

_FEATURE_IDS = {
    "f1": "weight_diff", "f2": "weight_diff_abs", "f3": "weight_diff_pct", "f4": "weight_ratio",
    "f5": "log_weight", "f6": "flag_weight_mismatch", "f7": "flag_zero_declared_weight",
    "f8": "value_per_kg", "f9": "log_value", "f10": "value_to_weight_ratio",
    "f11": "flag_high_value_density", "f12": "flag_low_value_density", "f13": "flag_zero_declared_value",
    "f14": "origin_country_risk", "f15": "dest_country_risk", "f16": "route_risk_total",
    "f17": "route_frequency", "f18": "route_frequency_log", "f19": "flag_high_risk_route",
    "f20": "hs_code_risk", "f21": "hs_code_first_digit", "f22": "day_of_week", "f23": "month",
    "f24": "day_of_month", "f25": "is_weekend", "f26": "is_month_end", "f27": "hour_of_day",
    "f28": "is_night", "f29": "is_business_hours", "f30": "dwell_time_log",
    "f31": "flag_excessive_dwell", "f32": "flag_minimal_dwell", "f33": "Trade_Regime_encoded",
    "f34": "Shipping_Line_encoded",
}
_DOUBLES = {
    "weight_diff", "weight_diff_abs", "weight_diff_pct", "weight_ratio", "log_weight", "value_per_kg",
    "log_value", "value_to_weight_ratio", "route_frequency_log", "dwell_time_log",
}
_BIGINTS = {"route_frequency", "Trade_Regime_encoded", "Shipping_Line_encoded"}


def _feature_sql(name: str) -> str:
    if name in _DOUBLES:
        return f"round({name}, 6) AS {name}"
    kind = "VARCHAR" if name == "hs_code_first_digit" else "BIGINT" if name in _BIGINTS else "INT"
    return f"CAST({name} AS {kind}) AS {name}"


def _feature_query(name: str):
    def run(spark, sf_dir):
        return rounded(derived.features(spark, sf_dir).select("Container_ID", name))

    return run


for _id, _name in _FEATURE_IDS.items():
    query(f"{_id}_{_name.lower()}", sql("feats", f"SELECT Container_ID, {_feature_sql(_name)} FROM feats"))(
        _feature_query(_name)
    )

_GROUPS = {
    "weight": (feature_ops.weight_features, K.FEATURES[:7]),
    "value": (feature_ops.value_features, K.FEATURES[7:13]),
    "route": (feature_ops.route_features, K.FEATURES[13:18]),
    "hs": (lambda df, _: feature_ops.hs_features(df), K.FEATURES[18:19]),
    "time": (lambda df, _: feature_ops.time_features(df), K.FEATURES[19:27]),
    "dwell": (feature_ops.dwell_features, K.FEATURES[27:30]),
    "category": (feature_ops.category_features, K.FEATURES[30:]),
}


def _group_query(make, names):
    def run(spark, sf_dir):
        rows = derived.cleaned(spark, sf_dir)
        fitted = profile.fit_profile(feature_ops.with_measures(rows))
        return rounded(make(rows, fitted).select("Container_ID", *names))

    return run


for _name, (_make, _names) in _GROUPS.items():
    query(
        f"f35_{_name}_group",
        sql("feats", "SELECT Container_ID, " + ", ".join(map(_feature_sql, _names)) + " FROM feats"),
    )(_group_query(_make, _names))


@query("f36_features", sql("feats", "SELECT Container_ID, " + ", ".join(map(_feature_sql, K.FEATURES)) + " FROM feats"))
def f36(spark, sf_dir):
    rows = feature_ops.engineer_features(derived.cleaned(spark, sf_dir))
    return rounded(rows.select("Container_ID", *feature_ops.available_features(rows)))


# --- L: labels --------------------------------------------------------------------------


@query(
    "l1_history_labels",
    sql("cleaned", "SELECT Container_ID, CAST(Origin_Country IN ('KP','IR','NG','PK','SY','LB','MY','TH')"
        " OR abs(Measured_Weight - Declared_Weight) / (Declared_Weight + 1e-9) * 100 > 50 OR Dwell_Time_Hours > 100"
        " OR Clearance_Status IN ('Flagged','Seized','Rejected','Held','Under Review') OR Declared_Value > 100000"
        " AS INT) AS is_risky FROM cleaned"),
)
def l1(spark, sf_dir):
    return labels.label_history(derived.cleaned(spark, sf_dir)).select("Container_ID", "is_risky")


@query(
    "l2_sample_labels",
    sql("measured", "SELECT Container_ID, CAST(Origin_Country IN ('KP','IR','NG','PK') OR weight_diff_abs > 200"
        " OR value_per_kg > 5000 OR value_per_kg < 10 AS INT) AS is_risky FROM measured"),
)
def l2(spark, sf_dir):
    return labels.label_sample(derived.cleaned(spark, sf_dir)).select("Container_ID", "is_risky")


@query("l3_fallback_labels", sql("judged", "SELECT Container_ID, label AS is_risky FROM judged"))
def l3(spark, sf_dir):
    return labels.label_fallback(derived.features(spark, sf_dir)).select("Container_ID", "is_risky")


@query(
    "l4_retrain_labels",
    sql("feats", "SELECT Container_ID, CAST(abs(weight_diff_pct) > 20 OR flag_high_value_density = 1"
        " OR origin_country_risk = 2 OR dest_country_risk = 2 OR flag_excessive_dwell = 1 AS INT) AS is_risky FROM feats"),
)
def l4(spark, sf_dir):
    return labels.label_retrain(derived.features(spark, sf_dir)).select("Container_ID", "is_risky")


_L5_WORDS = (
    "CASE doc_id % 12 WHEN 0 THEN source WHEN 1 THEN ' Very HIGH ' WHEN 2 THEN 'Low-ish' WHEN 3 THEN 'CLEARED'"
    " WHEN 4 THEN 'fraud' WHEN 5 THEN '1' WHEN 6 THEN '1.0' WHEN 7 THEN '0.0' WHEN 8 THEN '2' WHEN 9 THEN '-1'"
    " WHEN 10 THEN '0' END"
)


@query(
    "l5_normalize_labels",
    f"WITH t AS (SELECT doc_id, lower(trim(w)) AS t FROM (SELECT doc_id, {_L5_WORDS} AS w FROM documents))"
    " SELECT doc_id, CASE WHEN NOT isnan(TRY_CAST(t AS DOUBLE)) THEN CAST(TRY_CAST(t AS DOUBLE) > 0 AS INT)"
    " ELSE " + _L5_SQL + " END AS label FROM t",
)
def l5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{_L5_WORDS} AS w")
    return labels.normalize_labels(docs, "w").select("doc_id", "label")


@query(
    "l5_numeric_labels",
    "SELECT doc_id, CAST(quality > 0 AS INT) AS label FROM labels",
)
def l5_numbers(spark, sf_dir):
    return labels.normalize_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality").select("doc_id", "label")


@query(
    "l6_numeric_coercion",
    "SELECT event_id, CAST(coalesce(trunc(CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 3e10 ELSE value END), 0)"
    " AS BIGINT) AS label"
    " FROM events",
)
def l6(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn(
        "text", F.when(col("event_id") % 5 == 0, F.lit("none"))
        .when(col("event_id") % 5 == 1, F.lit("3e10"))
        .otherwise(col("value").cast("string")),
    )
    return labels.numeric_labels(events, "text").select("event_id", "label")


@query(
    "l7_single_class_guard",
    sql("cleaned", f"""SELECT Container_ID, CAST(row_number() OVER (ORDER BY {_DRAW_SQL})
  <= (SELECT greatest(count(*) // 10, 1) FROM cleaned) AS INT) AS label FROM cleaned"""),
)
def l7(spark, sf_dir):
    rows = derived.cleaned(spark, sf_dir).select("Container_ID", F.lit(0).alias("label"))
    return labels.guard_single_class(rows, "label").select("Container_ID", "label")


@query("l8_class_distribution", sql("judged", "SELECT label, count(*) AS n FROM judged GROUP BY 1"))
def l8(spark, sf_dir):
    return labels.label_distribution(derived.judged(spark, sf_dir), "label")


# --- P: profiles ------------------------------------------------------------------------


@query(
    "p1_moments",
    sql("moments", "SELECT round(weight_mean, 4) AS weight_mean, round(weight_std, 4) AS weight_std,"
        " round(density_mean, 4) AS density_mean, round(density_std, 4) AS density_std,"
        " round(dwell_mean, 4) AS dwell_mean, round(dwell_std, 4) AS dwell_std FROM moments"),
)
def p1(spark, sf_dir):
    rows = feature_ops.with_measures(derived.cleaned(spark, sf_dir))
    return rounded(rows.agg(*profile.moment_columns()), 4)


@query("p2_route_counts", sql("routes", "SELECT Origin_Country, Destination_Port, route_rows FROM routes"))
def p2(spark, sf_dir):
    return profile.route_counts(derived.cleaned(spark, sf_dir))


@query(
    "p3_category_counts",
    sql("lines", "SELECT 'Trade_Regime' AS category, Trade_Regime AS name, n FROM regimes"
        " UNION ALL SELECT 'Shipping_Line', Shipping_Line, n FROM lines"),
)
def p3(spark, sf_dir):
    fitted = profile.fit_profile(feature_ops.with_measures(derived.cleaned(spark, sf_dir)))
    parts = [
        t.select(F.lit(c).alias("category"), col(c).alias("name"), col(f"{c}_rows").alias("n"))
        for c, t in fitted.categories.items()
    ]
    return csv_source.union_inputs(parts)


def _profile_log(spark, sf_dir) -> ProfileLog:
    """The table in three batches of odd sizes, one of them taken in twice."""
    log = ProfileLog(spark, stage_path(spark, "profile-log"))
    cleaned = feature_ops.with_measures(derived.cleaned(spark, sf_dir))
    unfilled = cleaning.drop_missing_critical(derived.unique(spark, sf_dir))
    part = F.when(F.crc32(col("Container_ID").cast("binary")) % 10 == 0, 0).when(col("HS_Code") < "300000", 1).otherwise(2)
    for i in (0, 1, 2, 1):
        log.add(f"part{i}", cleaned.where(part == i), unfilled.where(part == i))
    return log


@query("p1_merged_moments", ORACLE["p1_moments"])
def p1_merged(spark, sf_dir):
    return rounded(_profile_log(spark, sf_dir).profile(medians=False).as_row(spark), 4)


@query("p2_merged_routes", ORACLE["p2_route_counts"])
def p2_merged(spark, sf_dir):
    return _profile_log(spark, sf_dir).profile(medians=False).lookup("route")


@query("p3_merged_categories", ORACLE["p3_category_counts"])
def p3_merged(spark, sf_dir):
    found = _profile_log(spark, sf_dir).profile(medians=False)
    parts = [
        t.select(F.lit(c).alias("category"), col(c).alias("name"), col(f"{c}_rows").alias("n"))
        for c, t in found.categories.items()
    ]
    return csv_source.union_inputs(parts)


@query("c5_sketched_median", "SELECT 'Dwell_Time_Hours' AS name, TRUE AS within_bound")
def c5_sketched(spark, sf_dir):
    """The share of values below and up to the sketched median encloses one half, but for the sketch's stated error."""
    medians = _profile_log(spark, sf_dir).medians()
    rows = cleaning.drop_missing_critical(derived.unique(spark, sf_dir))
    shares = [
        rows.where(col(name).isNotNull()).agg(
            F.lit(name).alias("name"),
            (
                (F.avg((col(name) < m).cast("double")) <= 0.5 + RANK_ERROR)
                & (F.avg((col(name) <= m).cast("double")) >= 0.5 - RANK_ERROR)
            ).alias("within_bound"),
        )
        for name, m in medians.items()
    ]
    return csv_source.union_inputs(shares)


# --- M: models and metrics --------------------------------------------------------------


@query(
    "m1_feature_matrix",
    sql("feats", "SELECT " + ", ".join(f"round(sum(CAST({c} AS DOUBLE)), 2) AS {c}" for c in K.FEATURES) + " FROM feats"),
)
def m1(spark, sf_dir):
    matrix = models.feature_matrix(derived.features(spark, sf_dir))
    return matrix.agg(*[F.round(F.sum(c), 2).alias(c) for c in K.FEATURES])


@query("m2_split", sql("judged", f"SELECT Container_ID, label, {_PART_SQL} AS part FROM judged"))
def m2(spark, sf_dir):
    train_rows, test_rows = models.split(derived.judged(spark, sf_dir))
    tagged = train_rows.withColumn("part", F.lit("train")).unionByName(test_rows.withColumn("part", F.lit("test")))
    return tagged.select("Container_ID", "label", "part")


@query(
    "m3_scaler",
    sql("feats", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_pop(CAST({c} AS DOUBLE)), 4)"
        f" AS deviation FROM feats WHERE {_PART_SQL} = 'train'" for c in K.FEATURES)),
)
def m3(spark, sf_dir):
    matrix = models.feature_matrix(derived.features(spark, sf_dir))
    train_rows, _ = models.split(matrix)
    return rounded(models.scale_table(train_rows, K.FEATURES), 4)


@query(
    "m4_class_weights",
    sql("judged", "SELECT label, round((SELECT count(*) FROM judged) / (2.0 * count(*)), 6) AS weight FROM judged GROUP BY 1"),
)
def m4(spark, sf_dir):
    rows = derived.judged(spark, sf_dir)
    weighted = models.with_class_weight(rows, models.balanced_weights(rows))
    return weighted.groupBy("label").agg(F.round(F.max("class_weight"), 6).alias("weight"))


def _fit_row(spark, stats: dict) -> DataFrame:
    """Sizes of both sides and checks of the measured figures."""
    support = {row["class"]: row["support"] for row in stats["report"]}
    cells = sum(stats[c] for c in _CELLS)
    shares = all(0 <= stats[k] <= 1 for k in ("accuracy", "precision", "recall", "f1_score", "auc"))
    return spark.createDataFrame(
        [(stats["train_size"], stats["test_size"], support["1"], cells == stats["test_size"], shares, stats["auc"] > 0.8)],
        "train_rows long, test_rows long, test_risky long, cells_add_up boolean, shares_in_range boolean,"
        " better_than_chance boolean",
    )


_FIT_SQL = sql("feats", f"SELECT {_SIDES_SQL}, TRUE AS cells_add_up, TRUE AS shares_in_range, TRUE AS better_than_chance FROM feats")


@query("m5_boosted_trees", _FIT_SQL)
def m5(spark, sf_dir):
    return _fit_row(spark, derived.trained(spark, sf_dir).model.stats)


@query(
    "m2_stratified_split",
    sql("judged", f"""SELECT Container_ID, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_DRAW_SQL})
  <= floor(0.2 * count(*) OVER (PARTITION BY label) + 0.5) THEN 'test' ELSE 'train' END AS part FROM judged"""),
)
def m2_stratified(spark, sf_dir):
    sides = models.stratified_split(derived.judged(spark, sf_dir).select("Container_ID", "label"))
    train_rows, test_rows = (d.withColumn("part", F.lit(p)) for d, p in zip(sides, ("train", "test")))
    return train_rows.unionByName(test_rows)


_DESCENT_FEATURES = ["flag_weight_mismatch", "origin_country_risk", "is_night"]
_DESCENT_STEPS, _DESCENT_RATE, _DESCENT_REG = 6, 0.8, 50.0


def _descent_sql() -> str:
    """Each step as two common table expressions: weights before it, and its loss and gradient."""
    names = [f"w{i}" for i in range(len(_DESCENT_FEATURES))]
    z = " + ".join(["b", *(f"{w} * x{i}" for i, w in enumerate(names))])
    steps = ["s0 AS (SELECT 0 AS step, 0e0 AS b, " + ", ".join(f"0e0 AS {w}" for w in names) + ")"]
    for k in range(_DESCENT_STEPS):
        gradient = ", ".join(f"avg((p - y) * x{i}) + {_DESCENT_REG}e0 / count(*) * any_value({w}) AS g{i}" for i, w in enumerate(names))
        square = " + ".join(f"any_value({w}) * any_value({w})" for w in names)
        steps.append(f"p{k} AS (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM matrix, s{k})")
        steps.append(
            f"g{k} AS (SELECT -avg(y * ln(p + 1e-15) + (1 - y) * ln(1 - p + 1e-15)) + {_DESCENT_REG}e0 / (2 * count(*)) * ({square}) AS loss,"
            f" {gradient}, avg(p - y) AS gb FROM p{k})"
        )
        moved = ", ".join(f"{w} - {_DESCENT_RATE}e0 * g{i} AS {w}" for i, w in enumerate(names))
        steps.append(f"s{k + 1} AS (SELECT {k + 1} AS step, b - {_DESCENT_RATE}e0 * gb AS b, {moved} FROM s{k}, g{k})")
    matrix = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(_DESCENT_FEATURES))
    parts = [f"SELECT {k} AS step, round(loss, 8) AS value, 'loss' AS name FROM g{k}" for k in range(_DESCENT_STEPS)]
    parts += [f"SELECT {_DESCENT_STEPS}, round({w}, 8), '{c}' FROM s{_DESCENT_STEPS}" for c, w in zip(_DESCENT_FEATURES, names)]
    parts.append(f"SELECT {_DESCENT_STEPS}, round(b, 8), 'bias' FROM s{_DESCENT_STEPS}")
    return sql(
        "feats",
        f", matrix AS (SELECT {matrix}, CAST({_RETRAIN_SQL} AS DOUBLE) AS y FROM feats),\n" + ",\n".join(steps) + "\n" + " UNION ALL ".join(parts),
    )


@query("m6_descent", _descent_sql())
def m6_descent(spark, sf_dir):
    """Losses and weights of a few steps of gradient descent over the whole table."""
    rows = labels.label_retrain(derived.features(spark, sf_dir), "label").select(*_DESCENT_FEATURES, "label")
    fitted = fit_descent(stage(rows, "descent"), _DESCENT_FEATURES, rate=_DESCENT_RATE, steps=_DESCENT_STEPS, reg=_DESCENT_REG)
    last = zip([*fitted.features, "bias"], [*fitted.weights, fitted.bias])
    found = [(k, float(v), "loss") for k, v in enumerate(fitted.losses)] + [(_DESCENT_STEPS, v, c) for c, v in last]
    return rounded(spark.createDataFrame(found, "step int, value double, name string"), 8)


@query(
    "m6_logistic",
    sql("feats", f"SELECT {_SIDES_SQL}, TRUE AS cells_add_up, TRUE AS shares_in_range, TRUE AS better_than_chance,"
        " TRUE AS loss_falls FROM feats"),
)
def m6(spark, sf_dir):
    run = derived.trained(spark, sf_dir, use_logistic=True)
    losses = models.loss_history(run.model.classifier)
    falls = losses[-1] < losses[0] and all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    return _fit_row(spark, run.model.stats).withColumn("loss_falls", F.lit(falls))


@query(
    "m7_cross_entropy",
    sql("judged", "SELECT round(-avg(label * ln(score + 1e-15) + (1 - label) * ln(1 - score + 1e-15)), 6) AS loss FROM judged"),
)
def m7(spark, sf_dir):
    return rounded(metrics.cross_entropy(derived.judged(spark, sf_dir), "label", "score"))


@query(
    "m8_isolation_forest",
    "SELECT CAST(i AS INTEGER) AS tree, TRUE AS binary_tree, TRUE AS within_depth, TRUE AS rows_add_up FROM range(100) t(i)",
)
def m8(spark, sf_dir):
    rows = derived.features(spark, sf_dir)
    forest = fit_forest(rows, feature_ops.available_features(rows))
    leaf = col("feature") < 0
    return forest.nodes.groupBy("tree").agg(
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary_tree"),
        (F.max(F.when(leaf, col("depth"))) <= max_depth(forest.sample)).alias("within_depth"),
        (F.sum(F.when(leaf, col("size"))) == forest.sample).alias("rows_add_up"),
    )


@query(
    "m9_anomaly_scores",
    sql("cleaned", "SELECT Container_ID, TRUE AS in_range, TRUE AS low_is_0, TRUE AS high_is_1 FROM cleaned"),
)
def m9(spark, sf_dir):
    rows = derived.features(spark, sf_dir)
    forest = fit_forest(rows, feature_ops.available_features(rows))
    raw = stage(rows.select("Container_ID", isolation_score(forest).alias("isolation")))
    scored = raw.select("Container_ID", scaled_anomaly(col("isolation"), score_bounds(raw)).alias("s"))
    low, high = scored.agg(F.min("s")).scalar(), scored.agg(F.max("s")).scalar()
    return scored.select(
        "Container_ID",
        col("s").between(0, 1).alias("in_range"),
        (low < 1e-6).alias("low_is_0"),
        (high == 1).alias("high_is_1"),
    )


@query("m10_classifier_scores", sql("cleaned", "SELECT Container_ID, TRUE AS in_range, TRUE AS agrees FROM cleaned"))
def m10(spark, sf_dir):
    model = derived.trained(spark, sf_dir).model
    scored = models.classifier_scores(derived.features(spark, sf_dir), model)
    odds = vector_to_array(col("rawPrediction"))
    again = model.classifier.transform(models.feature_matrix(derived.features(spark, sf_dir), model.features))
    again = again.select("Container_ID", (1 / (1 + F.exp(-2 * odds[1]))).alias("expected"))
    return scored.join(again, "Container_ID").select(
        "Container_ID",
        col("classifier_score").between(0, 1).alias("in_range"),
        (F.abs(col("classifier_score") - col("expected")) < 1e-9).alias("agrees"),
    )


@query("m11_validation_metrics", sql("judged", f"SELECT {_METRIC_SQL}, {', '.join(_CELLS)} FROM cells", *_AUC_STEPS))
def m11(spark, sf_dir):
    return rounded(metrics.binary_metrics(derived.judged(spark, sf_dir)))


@query(
    "m12_class_report",
    sql("judged", """SELECT 'class', round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score, support FROM everything""".replace("'class'", "class"),
        *_AUC_STEPS,
        ("per_class", """SELECT '0' AS class, true_negative / CAST(true_negative + false_negative AS DOUBLE) AS precision,
  true_negative / CAST(true_negative + false_positive AS DOUBLE) AS recall,
  2 * true_negative / CAST(2 * true_negative + false_negative + false_positive AS DOUBLE) AS f1_score,
  true_negative + false_positive AS support FROM cells UNION ALL
  SELECT '1', true_positive / CAST(true_positive + false_positive AS DOUBLE),
  true_positive / CAST(true_positive + false_negative AS DOUBLE),
  2 * true_positive / CAST(2 * true_positive + false_positive + false_negative AS DOUBLE),
  true_positive + false_negative FROM cells"""),
        ("everything", """SELECT * FROM per_class UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM per_class UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class""")),
)
def m12(spark, sf_dir):
    return rounded(metrics.class_report(derived.judged(spark, sf_dir)))


@query("m13_roc_auc", sql("judged", "SELECT round(roc_auc, 6) AS roc_auc FROM auc", *_AUC_STEPS))
def m13(spark, sf_dir):
    return rounded(metrics.roc_auc(derived.judged(spark, sf_dir)))


@query(
    "m15_evaluation_rows",
    sql("judged", "SELECT Container_ID AS container_id, label AS actual_label, prediction AS predicted_label,"
        " round(score * 100, 4) AS risk_score, risk_level, round(classifier_score, 6) AS classifier_score,"
        " round(anomaly_score, 6) AS anomaly_score, CAST(label = prediction AS INT) AS is_correct FROM judged"),
)
def m15(spark, sf_dir):
    return metrics.evaluation_rows(derived.judged(spark, sf_dir))


@query(
    "m16_label_counts",
    sql("cleaned", "SELECT count(*) AS total_rows, count(label) AS rows_with_valid_labels,"
        " count(*) FILTER (WHERE label IS NULL) AS rows_without_valid_labels, (SELECT count(*) FROM cleaned) AS"
        " rows_after_cleaning FROM (SELECT " + _L5_SQL + " AS label FROM (SELECT lower(trim(Clearance_Status)) AS t FROM ships))"),
)
def m16(spark, sf_dir):
    rows = labels.normalize_labels(shipments(spark, sf_dir), "Clearance_Status")
    return metrics.label_row_counts(rows, derived.cleaned(spark, sf_dir))


# --- R: scoring -------------------------------------------------------------------------


@query("r1_blend", sql("levelled", "SELECT Container_ID, round(0.4e0 * classifier_score + 0.6e0 * anomaly_score, 6) AS score FROM levelled"))
def r1(spark, sf_dir):
    rows = derived.levelled(spark, sf_dir)
    return rows.select(
        "Container_ID", r(scoring.risk_score(col("classifier_score"), col("anomaly_score"), (2.0, 3.0))).alias("score")
    )


@query("r2_level", sql("levelled", "SELECT Container_ID, risk_level FROM levelled"))
def r2(spark, sf_dir):
    rows = derived.levelled(spark, sf_dir)
    return rows.select("Container_ID", scoring.risk_level(col("score")).alias("risk_level"))


@query("r3_score_rows", sql("levelled", "SELECT Container_ID, round(score, 6) AS score, risk_level FROM levelled"))
def r3(spark, sf_dir):
    rows = scoring.score_rows(derived.levelled(spark, sf_dir).drop("score", "risk_level"))
    return rounded(rows.select("Container_ID", "score", "risk_level"))


@query("r4_confidence", sql("levelled", "SELECT Container_ID AS container_id, round(greatest(classifier_score, anomaly_score), 6) AS confidence FROM levelled"))
def r4(spark, sf_dir):
    return rounded(derived.predictions(spark, sf_dir).select("container_id", "confidence"))


@query("r5_displayed_score", sql("levelled", "SELECT Container_ID AS container_id, round(score * 100, 6) AS risk_score FROM levelled"))
def r5(spark, sf_dir):
    return rounded(derived.predictions(spark, sf_dir).select("container_id", "risk_score"))


@query("r6_batch_predict", sql("explained", PREDICTION_SQL))
def r6(spark, sf_dir):
    store = BatchStore(spark, stage_path(spark, "batches"))
    batch = jobs.score_table(shipments(spark, sf_dir), ORDER, rule_columns, store)
    return rounded(store.predictions(batch))


# --- X: explanations --------------------------------------------------------------------

_TEXT_IDS = {
    "x1_weight_text": explain.weight_text, "x2_value_text": explain.value_text,
    "x3_route_text": explain.route_text, "x4_dwell_text": explain.dwell_text,
    "x5_timing_text": explain.timing_text, "x6_hs_text": explain.hs_text,
}


def _text_query(make):
    def run(spark, sf_dir):
        return derived.features(spark, sf_dir).select("Container_ID", make().alias("found"))

    return run


for _name, _make in _TEXT_IDS.items():
    _column = _name.split("_", 1)[1]
    query(_name, sql("texts", f"SELECT Container_ID, {_column} AS found FROM texts"))(_text_query(_make))


@query("x7_assembled_text", sql("explained", "SELECT Container_ID, risk_level, explanation_summary FROM explained"))
def x7(spark, sf_dir):
    return derived.levelled(spark, sf_dir).select(
        "Container_ID", "risk_level", explain.explanation().alias("explanation_summary")
    )


@query("x8_predictions", sql("explained", PREDICTION_SQL))
def x8(spark, sf_dir):
    return rounded(derived.predictions(spark, sf_dir))


# --- A: reports -------------------------------------------------------------------------

_LEVEL_COUNTS_SQL = ", ".join(f"count(*) FILTER (WHERE level = '{v}') AS {v.lower()}" for v in K.LEVELS)
_FLAGGED_SQL = "level IN ('Critical', 'High')"
_BY_SCORE_SQL = "score DESC, id ASC"


@query(
    "a1_group_sizes",
    sql("spine", "SELECT s.level, CAST(level_order AS INT) AS level_order, coalesce(n, 0) AS n, round(lo, 6) AS min_score,"
        " round(hi, 6) AS max_score FROM spine s LEFT JOIN (SELECT level, count(*) AS n, min(score) AS lo,"
        " max(score) AS hi FROM scored GROUP BY 1) c ON c.level = s.level"),
)
def a1(spark, sf_dir):
    return rounded(reports.group_sizes(derived.scored(spark, sf_dir)))


@query("a1_grouped_rows", sql("scored", "SELECT id, level, round(score, 6) AS score FROM scored"))
def a1_rows(spark, sf_dir):
    return rounded(reports.group_by_level(derived.scored(spark, sf_dir)).select("id", "level", "score"))


@query(
    "a2_summary",
    sql("scored", f"SELECT count(*) AS total_containers, {_LEVEL_COUNTS_SQL},"
        " count(*) FILTER (WHERE anomaly_score > 0.7) AS anomalies, round(avg(score), 6) AS average_risk_score FROM scored"),
)
def a2(spark, sf_dir):
    return rounded(reports.summary(derived.scored(spark, sf_dir)))


@query("a3_anomaly_count", sql("scored", "SELECT count(*) AS anomalies FROM scored WHERE anomaly_score > 0.7"))
def a3(spark, sf_dir):
    return reports.summary(derived.scored(spark, sf_dir)).select("anomalies")


@query("a4_clearance_distribution", sql("cleaned", "SELECT Clearance_Status AS clearance_status, count(*) AS n FROM cleaned GROUP BY 1"))
def a4(spark, sf_dir):
    return reports.clearance_distribution(derived.cleaned(spark, sf_dir))


@query("a5_priority_order", sql("scored", _scored_sql(LISTED) + " FROM scored"))
def a5(spark, sf_dir):
    return _listed(reports.priority_order(derived.scored(spark, sf_dir)))


@query(
    "a6_summary_record",
    sql("scored", "SELECT count(*) AS total_containers, "
        + ", ".join(f"count(*) FILTER (WHERE level = '{v}') AS dist_{v.lower()}" for v in K.LEVELS)
        + ", round(avg(score), 6) AS average_risk_score FROM scored"),
)
def a6(spark, sf_dir):
    record = reports.summary_record(derived.scored(spark, sf_dir))
    return rounded(record.select(
        "total_containers",
        *[col("risk_distribution")[v.lower()].alias(f"dist_{v.lower()}") for v in K.LEVELS],
        "average_risk_score",
    ))


@query("a7_level_distribution", sql("scored", "SELECT level, count(*) AS n FROM scored GROUP BY 1"))
def a7(spark, sf_dir):
    return reports.level_distribution(derived.scored(spark, sf_dir))


_FLAGS = [c for c in K.FEATURES if c.startswith("flag_")]


@query(
    "a8_top_risk_factors",
    sql("feats", "SELECT factor, n FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS factor, CAST(sum({c}) AS BIGINT) AS n FROM feats" for c in _FLAGS)
        + ") WHERE n > 0 ORDER BY n DESC, factor LIMIT 5"),
)
def a8(spark, sf_dir):
    return reports.top_risk_factors(derived.features(spark, sf_dir))


@query(
    "a9_score_histogram",
    sql("scored", "SELECT CAST(b AS INT) AS bucket, CAST(b * 10 AS VARCHAR) || '-' || CAST(b * 10 + 9 AS VARCHAR) AS range,"
        " (SELECT count(*) FROM scored WHERE least(9, floor(score / 10)) = b) AS n FROM range(10) t(b)"),
)
def a9(spark, sf_dir):
    return reports.score_histogram(derived.scored(spark, sf_dir))


@query("a10_top_origins", sql("scored", f"SELECT origin AS name, count(*) AS n FROM scored WHERE {_FLAGGED_SQL} GROUP BY 1 ORDER BY n DESC, name LIMIT 8"))
def a10(spark, sf_dir):
    return reports.top_origins(derived.scored(spark, sf_dir))


@query("a11_filter_level", sql("scored", _scored_sql(LISTED) + " FROM scored WHERE level = 'High'"))
def a11(spark, sf_dir):
    return _listed(reports.filter_level(derived.scored(spark, sf_dir), "High"))


@query(
    "a12_search",
    sql("scored", _scored_sql(LISTED) + " FROM scored WHERE contains(lower(id), 'd#4') OR contains(lower(origin), 'd#4')"
        " OR contains(lower(line), 'd#4') OR contains(hs, 'd#4')"),
)
def a12(spark, sf_dir):
    return _listed(reports.search(derived.scored(spark, sf_dir), "D#4"))


@query("a13_sort", sql("scored", _scored_sql(LISTED) + " FROM scored"))
def a13(spark, sf_dir):
    return _listed(reports.sort_by(derived.scored(spark, sf_dir), "value"))


@query("a14_deep_page", sql("scored", _scored_sql(LISTED) + f" FROM scored ORDER BY {_BY_SCORE_SQL} LIMIT 20 OFFSET 1980"))
def a14_deep(spark, sf_dir):
    return _listed(reports.page(derived.scored(spark, sf_dir), 100))


@query("a14_page", sql("scored", _scored_sql(LISTED) + f" FROM scored ORDER BY {_BY_SCORE_SQL} LIMIT 20 OFFSET 40"))
def a14(spark, sf_dir):
    return _listed(reports.page(derived.scored(spark, sf_dir), 3))


@query(
    "a14_page_after",
    sql("scored", _scored_sql(LISTED) + f" FROM scored ORDER BY {_BY_SCORE_SQL} LIMIT 20 OFFSET 20"),
)
def a14_after(spark, sf_dir):
    rows = derived.scored(spark, sf_dir)
    last = reports.page(rows, 1).orderBy("score", F.desc("id")).first()
    return _listed(reports.page_after(rows, last["score"], last["id"]))


@query("a14_page_count", sql("scored", "SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM scored"))
def a14_count(spark, sf_dir):
    return reports.page_count(derived.scored(spark, sf_dir))


_SHARE_SQL = """SELECT s.level, coalesce(n, 0) AS n,
  round(coalesce(n, 0) * 100.0 / (SELECT count(*) FROM scored), 6) AS percent{extra} FROM spine s
  LEFT JOIN (SELECT level, count(*) AS n, sum(value) AS v FROM scored GROUP BY 1) c ON c.level = s.level"""


@query("a15_level_shares", sql("spine", _SHARE_SQL.format(extra="")))
def a15(spark, sf_dir):
    return rounded(reports.level_shares(derived.scored(spark, sf_dir)))


@query(
    "a16_report_totals",
    sql("scored", f"SELECT count(*) AS total, {_LEVEL_COUNTS_SQL}, round(avg(score), 6) AS avg_score,"
        f" round(max(score), 6) AS max_score, round(min(score), 6) AS min_score,"
        f" count(*) FILTER (WHERE {_FLAGGED_SQL}) AS flagged,"
        f" round(count(*) FILTER (WHERE {_FLAGGED_SQL}) * 100.0 / count(*), 6) AS flag_rate FROM scored"),
)
def a16(spark, sf_dir):
    return rounded(reports.report_totals(derived.scored(spark, sf_dir)))


@query(
    "a17_line_breakdown",
    sql("scored", f"SELECT line AS name, count(*) AS total, count(*) FILTER (WHERE {_FLAGGED_SQL}) AS flagged,"
        f" round(count(*) FILTER (WHERE {_FLAGGED_SQL}) * 100.0 / count(*), 6) AS rate FROM scored"
        " WHERE line NOT IN ('', 'N/A') GROUP BY 1 ORDER BY flagged DESC, name LIMIT 8"),
)
def a17(spark, sf_dir):
    return rounded(reports.line_breakdown(derived.scored(spark, sf_dir)))


@query("a18_hs_breakdown", sql("scored", f"SELECT hs AS name, count(*) AS n FROM scored WHERE {_FLAGGED_SQL} GROUP BY 1 ORDER BY n DESC, name LIMIT 8"))
def a18(spark, sf_dir):
    return reports.hs_breakdown(derived.scored(spark, sf_dir))


@query("a19_value_at_risk", sql("scored", f"SELECT round(sum(value), 2) AS value_at_risk FROM scored WHERE {_FLAGGED_SQL}"))
def a19(spark, sf_dir):
    return rounded(reports.value_at_risk(derived.scored(spark, sf_dir)), 2)


@query("a20_level_breakdown", sql("spine", _SHARE_SQL.format(extra=", round(coalesce(v, 0), 2) AS value_sum")))
def a20(spark, sf_dir):
    rows = reports.level_breakdown(derived.scored(spark, sf_dir))
    return rows.withColumns({"percent": r("percent"), "value_sum": r("value_sum", 2)})


@query(
    "a21_top_scores",
    sql("scored", f"SELECT id, level, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY {_BY_SCORE_SQL}) AS INT) AS rank"
        f" FROM scored ORDER BY {_BY_SCORE_SQL} LIMIT 10"),
)
def a21(spark, sf_dir):
    return rounded(reports.top_scores(derived.scored(spark, sf_dir)).select("id", "level", "score", "rank"))


def _some_id(rows: DataFrame) -> str:
    """The lowest id of a level, as an example container."""
    return rows.where(col("level") == "High").agg(F.min("id")).first()[0]


_SOME_ID_SQL = "(SELECT min(id) FROM scored WHERE level = 'High')"
_RANKED_STEP = ("ranks", f"SELECT *, row_number() OVER (ORDER BY {_BY_SCORE_SQL}) AS rank FROM scored")


@query("a22_lookup", sql("scored", _scored_sql() + f" FROM scored WHERE id = {_SOME_ID_SQL}"))
def a22(spark, sf_dir):
    rows = derived.scored(spark, sf_dir)
    return rounded(reports.find_container(rows, _some_id(rows)))


@query("a23_rank_all", sql("scored", "SELECT id, round(score, 6) AS score, rank FROM ranks", _RANKED_STEP))
def a23(spark, sf_dir):
    return rounded(reports.rank_all(derived.scored(spark, sf_dir)))


@query("a23_rank_of", sql("scored", f"SELECT id, rank FROM ranks WHERE id = {_SOME_ID_SQL}", _RANKED_STEP))
def a23_one(spark, sf_dir):
    rows = derived.scored(spark, sf_dir)
    return reports.rank_of(rows, _some_id(rows))


_BESIDE_SQL = f"lag(id) OVER (ORDER BY {_BY_SCORE_SQL}) AS prev_id, lead(id) OVER (ORDER BY {_BY_SCORE_SQL}) AS next_id"


@query("a24_neighbours_all", sql("scored", f"SELECT id, rank, {_BESIDE_SQL} FROM ranks", _RANKED_STEP))
def a24(spark, sf_dir):
    return reports.neighbours_all(derived.scored(spark, sf_dir))


@query("a24_neighbours_of", sql("scored", f"SELECT * FROM (SELECT id, {_BESIDE_SQL} FROM scored) WHERE id = {_SOME_ID_SQL}"))
def a24_one(spark, sf_dir):
    rows = derived.scored(spark, sf_dir)
    return reports.neighbours_of(rows, _some_id(rows))


_PEERS_STEPS = (
    ("heads", f"SELECT origin, level, id AS peer_id, row_number() OVER (PARTITION BY origin, level ORDER BY {_BY_SCORE_SQL}) AS p"
     " FROM scored WHERE level <> 'Low'"),
    ("pairs", "SELECT s.id, s.origin, s.level, h.peer_id, row_number() OVER (PARTITION BY s.id ORDER BY h.p) AS place"
     " FROM scored s JOIN heads h ON h.origin = s.origin AND h.level = s.level AND h.peer_id <> s.id WHERE h.p <= 6"),
)


@query("a25_peers_all", sql("scored", "SELECT id, origin, level, peer_id, CAST(place AS INT) AS place FROM pairs WHERE place <= 5", *_PEERS_STEPS))
def a25(spark, sf_dir):
    return reports.peers_all(derived.scored(spark, sf_dir))


@query("a25_peers_of", sql("scored", f"SELECT peer_id AS id FROM pairs WHERE place <= 5 AND id = {_SOME_ID_SQL}", *_PEERS_STEPS))
def a25_one(spark, sf_dir):
    rows = derived.scored(spark, sf_dir)
    return reports.peers_of(rows, _some_id(rows)).select("id")


_CHART_CLASS = "CASE WHEN origin IN ({}) THEN 90e0 WHEN origin IN ({}) THEN 55e0 ELSE 15e0 END".format(
    ", ".join(f"'{c}'" for c in K.CHART_HIGH_RISK_COUNTRIES), ", ".join(f"'{c}'" for c in K.CHART_MEDIUM_RISK_COUNTRIES)
)


@query(
    "a26_radar",
    sql("scored", "SELECT id, 'Weight gap' AS factor, round(least(100, abs((mw - dw) / dw * 100)), 6) AS value FROM scored"
        " UNION ALL SELECT id, 'Value/kg', round(least(100, ln(1 + value / dw) * 8), 6) FROM scored"
        " UNION ALL SELECT id, 'Risk Score', round(score, 6) FROM scored"
        " UNION ALL SELECT id, 'Dwell Time', round(least(100, dwell / 200 * 100), 6) FROM scored"
        f" UNION ALL SELECT id, 'Origin Risk', {_CHART_CLASS} FROM scored"),
)
def a26(spark, sf_dir):
    return rounded(reports.radar(derived.scored(spark, sf_dir)))


@query(
    "a27_display_metrics",
    sql("scored", "SELECT id, value / dw AS value_per_kg, round(mw - dw, 6) AS weight_gap,"
        " round((mw - dw) / dw * 100, 6) AS weight_gap_pct, CAST(value / dw > 500 AS INT) AS high_density,"
        " CAST(dwell > 72 OR dwell < 2 AS INT) AS odd_dwell, CAST(abs(mw - dw) > 1000 AS INT) AS large_gap,"
        " CAST(abs((mw - dw) / dw * 100) > 20 AS INT) AS large_gap_pct FROM scored"),
)
def a27(spark, sf_dir):
    # the density is a single division, the same in both engines; rounding it would meet ties
    rows = reports.display_metrics(derived.scored(spark, sf_dir))
    return rows.withColumns({c: r(c) for c in ("weight_gap", "weight_gap_pct")})


@query("a28_attach_attributes", sql("scored", _scored_sql() + " FROM scored"))
def a28(spark, sf_dir):
    return rounded(reports.attach_attributes(derived.predictions(spark, sf_dir), derived.cleaned(spark, sf_dir)))


_LAST_ORDER_SQL = ", ".join(f"{c} DESC" for c in ORDER)


@query(
    "a28_attach_last_row",
    sql("explained", "SELECT p.Container_ID AS id, round(p.score * 100, 6) AS score, round(coalesce(l.Declared_Value, 0), 4) AS value,"
        " round(coalesce(l.Measured_Weight, 0), 4) AS mw, coalesce(l.Origin_Country, 'N/A') AS origin FROM explained p"
        f" LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Container_ID ORDER BY {_LAST_ORDER_SQL}) AS last"
        " FROM ships) WHERE last = 1) l ON l.Container_ID = p.Container_ID"),
)
def a28_last(spark, sf_dir):
    rows = reports.attach_attributes(
        derived.predictions(spark, sf_dir), shipments(spark, sf_dir), keep="last", order_cols=ORDER
    )
    return rows.select("id", r("score").alias("score"), r("value", 4).alias("value"), r("mw", 4).alias("mw"), "origin")


def _rank_index(spark, sf_dir) -> RankIndex:
    """The scored table in ranges of about 4,000 rows, written once for all queries over it."""

    def make() -> RankIndex:
        index = RankIndex(spark, stage_path(spark, "rank-index"))
        index.write(derived.scored(spark, sf_dir), range_rows=4000, bucket_rows=8000, posting_rows=100_000)
        return index

    return derived.once(spark, sf_dir, "rank-index", make)


@query("a12_indexed_search", ORACLE["a12_search"])
def a12_indexed(spark, sf_dir):
    return _listed(_rank_index(spark, sf_dir).search("D#4"))


@query("a14_indexed_page", ORACLE["a14_deep_page"])
def a14_indexed(spark, sf_dir):
    return _listed(_rank_index(spark, sf_dir).page(100))


@query("a22_indexed_lookup", ORACLE["a22_lookup"])
def a22_indexed(spark, sf_dir):
    return rounded(_rank_index(spark, sf_dir).find(_some_id(derived.scored(spark, sf_dir))))


@query("a23_indexed_rank", ORACLE["a23_rank_of"])
def a23_indexed(spark, sf_dir):
    return _rank_index(spark, sf_dir).rank_of(_some_id(derived.scored(spark, sf_dir)))


@query("a24_indexed_neighbours", ORACLE["a24_neighbours_of"])
def a24_indexed(spark, sf_dir):
    return _rank_index(spark, sf_dir).neighbours_of(_some_id(derived.scored(spark, sf_dir)))


@query("a28_bucketed_attach", ORACLE["a28_attach_attributes"])
def a28_bucketed(spark, sf_dir):
    path = stage_path(spark, "buckets")
    store = BucketedStore(spark, path, "scored_" + path[-32:], buckets=16)
    predicted = derived.predictions(spark, sf_dir)
    store.write("predictions", predicted.withColumn("container_id", F.trim("container_id")), "container_id")
    store.write("attributes", reports.attribute_rows(derived.cleaned(spark, sf_dir)), "_id")
    return rounded(reports.with_attribute_defaults(store.joined("predictions", "container_id", "attributes", "_id")))


@query("a29_sample_head", sql("scored", "SELECT id, level, round(score, 6) AS score, substr(expl, 1, 60) AS expl FROM scored ORDER BY id LIMIT 5"))
def a29(spark, sf_dir):
    return rounded(reports.sample_head(derived.scored(spark, sf_dir), ["id"]))


# --- J: jobs ----------------------------------------------------------------------------


@query("j1_prepare", ORACLE["s6_labelled_csv"])
def j1(spark, sf_dir):
    rows = jobs.prepare_history(_raw(spark, sf_dir))
    return rows.groupBy("Container_ID", "is_risky").agg(F.count(F.lit(1)).alias("n"))


@query("j2_train", _FIT_SQL)
def j2(spark, sf_dir):
    store = ModelStore(spark, stage_path(spark, "models"))
    run = derived.trained(spark, sf_dir)
    store.save(run.model, run.profile)
    model, _ = store.load()
    return _fit_row(spark, {**run.model.stats, **model.stats})


@query("j3_score_batch", sql("explained", PREDICTION_SQL))
def j3(spark, sf_dir):
    store = BatchStore(spark, stage_path(spark, "batches"))
    fitted = profile.fit_profile(feature_ops.with_measures(derived.cleaned(spark, sf_dir)))
    batch = jobs.score_table(shipments(spark, sf_dir), ORDER, rule_columns, store, profile=fitted)
    return rounded(store.predictions(batch))


def _blended(rows: DataFrame) -> list[Column]:
    """Whether a prediction's score, level and confidence follow from its two model scores."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * col("classifier_score") + 0.3 * col("anomaly_score")))
    level = F.when(score >= 0.75, "Critical").when(score >= 0.5, "High").when(score >= 0.25, "Medium").otherwise("Low")
    best = F.greatest("classifier_score", "anomaly_score")
    return [
        (F.abs(col("risk_score") - score * 100) < 1e-9).alias("blended"),
        (col("risk_level") == level).alias("levelled"),
        (F.abs(col("confidence") - best) < 1e-12).alias("confident"),
    ]


def _same_scores(spark, sf_dir, run, rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """Stored scores beside those of a trained model on the cleaned rows."""
    features = feature_ops.engineer_features(derived.cleaned(spark, sf_dir), run.profile)
    own = models.predict_scores(features, run.model, run.profile.anomaly_bounds).select(
        col("Container_ID").alias("_id"), col("classifier_score").alias("_c"), col("anomaly_score").alias("_a")
    )
    same = F.abs(col("classifier_score") - col("_c")) + F.abs(col("anomaly_score") - col("_a")) < 1e-12
    return rows.join(own, col(name) == col("_id")).select(col(name).alias("Container_ID"), same.alias("same_scores"), *more)


@query(
    "j3_trained_batch",
    sql("cleaned", "SELECT Container_ID, TRUE AS same_scores, TRUE AS blended, TRUE AS levelled, TRUE AS confident FROM cleaned"),
)
def j3_trained(spark, sf_dir):
    """A batch scored by a trained model with its own profile, whose rows a frozen one would score alike."""
    run = derived.trained(spark, sf_dir)
    store = BatchStore(spark, stage_path(spark, "batches"))
    batch = jobs.score_table(derived.declared(spark, sf_dir), ORDER, run.model, store, profile=run.profile)
    rows = store.predictions(batch)
    return _same_scores(spark, sf_dir, run, rows, "container_id", *_blended(rows))


@query("j6_trained_scores", sql("cleaned", "SELECT Container_ID, TRUE AS same_scores FROM cleaned"))
def j6_trained(spark, sf_dir):
    run = derived.trained(spark, sf_dir)
    rows = jobs.score_rows_of(derived.unique(spark, sf_dir), ORDER, run.model, profile=run.profile)
    return _same_scores(spark, sf_dir, run, rows, "container_id")


#: Scored rows of the shipments whose status is a readable label, with row counts of the input.
_STATUS_STEPS = sql("judged", "").replace(
    "ships AS (", "received AS (", 1
).replace(
    "ranked AS (",
    "marked AS (SELECT *, " + _L5_SQL.replace("t IN", "lower(trim(Clearance_Status)) IN").replace(
        "contains(t,", "contains(lower(trim(Clearance_Status)),"
    ) + " AS status FROM received),\nships AS (SELECT * FROM marked WHERE status IS NOT NULL),\nranked AS (",
    1,
).rstrip()
_STATUS_REPORT_SQL = (
    _STATUS_STEPS
    + ", cells0 AS (SELECT *, status AS truth FROM judged),\n"
    + ",\n".join(f"{n} AS ({body.replace('label', 'truth').replace('FROM judged', 'FROM cells0')})" for n, body in _AUC_STEPS)
    + f"""
SELECT (SELECT count(*) FROM received) AS total_rows, (SELECT count(*) FROM ships) AS rows_with_valid_labels,
  (SELECT count(*) FROM marked WHERE status IS NULL) AS rows_without_valid_labels,
  (SELECT count(*) FROM judged) AS rows_after_cleaning, {_METRIC_SQL}, round((SELECT roc_auc FROM auc), 6) AS roc_auc,
  {', '.join(_CELLS)} FROM cells"""
)


def _status_report(spark, sf_dir) -> DataFrame:
    report, _ = jobs.evaluate(shipments(spark, sf_dir), ORDER, rule_columns, label="Clearance_Status")
    return report


@query(
    "j4_trained_evaluate",
    _STATUS_STEPS + """
SELECT (SELECT count(*) FROM received) AS total_rows, (SELECT count(*) FROM ships) AS rows_with_valid_labels,
  (SELECT count(*) FROM judged) AS rows_after_cleaning, (SELECT count(*) FROM judged WHERE status = 1) AS risky,
  TRUE AS cells_agree, TRUE AS accuracy_agrees, TRUE AS auc_in_range""",
)
def j4_trained(spark, sf_dir):
    """The report of a trained model, its cells and accuracy counted again from the row-level table."""
    run = derived.trained(spark, sf_dir)
    report, rows = jobs.evaluate(derived.declared(spark, sf_dir), ORDER, run.model, label="Clearance_Status")
    truth, said = col("actual_label"), col("predicted_label")
    pairs = ((0, 0), (0, 1), (1, 0), (1, 1))
    counted = rows.agg(
        F.count_if(truth == 1).alias("risky"),
        F.array(*(F.count_if((truth == t) & (said == p)) for t, p in pairs)).alias("cells"),
        F.avg((truth == said).cast("double")).alias("right"),
    )
    cells = F.array(*(col("confusion_matrix")[c] for c in _CELLS))
    return report.crossJoin(counted).select(  # one row each
        "total_rows", "rows_with_valid_labels", "rows_after_cleaning", "risky",
        (cells == col("cells")).alias("cells_agree"),
        (F.abs(col("accuracy") - col("right")) < 1e-12).alias("accuracy_agrees"),
        col("roc_auc").between(0, 1).alias("auc_in_range"),
    )


@query("m14_evaluate", _STATUS_REPORT_SQL)
def m14(spark, sf_dir):
    return _flat_report(_status_report(spark, sf_dir))


@query("s13_evaluation_json", _STATUS_REPORT_SQL)
def s13(spark, sf_dir):
    path = stage_path(spark, "s13")
    sinks.write_report_json(_status_report(spark, sf_dir), path)
    return _flat_report(spark.read.json(path))


def _stored_batch(spark, sf_dir) -> tuple[BatchStore, str]:
    store = BatchStore(spark, stage_path(spark, "batches"))
    return store, jobs.score_table(shipments(spark, sf_dir), ORDER, rule_columns, store)


@query("j3_accounting", ORACLE["c9_row_accounting"])
def j3_accounting(spark, sf_dir):
    store, batch = _stored_batch(spark, sf_dir)
    return store.accounting(batch)


@query(
    "j3_rejects",
    sql("med", f"""SELECT Container_ID, reason AS reject_reason, count(*) AS n
  FROM (SELECT Container_ID, {_REASON_SQL} AS reason FROM ranked) WHERE reason IS NOT NULL GROUP BY 1, 2"""),
)
def j3_rejects(spark, sf_dir):
    store, batch = _stored_batch(spark, sf_dir)
    return store.rejects(batch).groupBy("Container_ID", "reject_reason").agg(F.sum("copies").alias("n"))


@query("j3_statuses", ORACLE["a4_clearance_distribution"])
def j3_statuses(spark, sf_dir):
    store, batch = _stored_batch(spark, sf_dir)
    return store.statuses(batch)


@query("j4_evaluate", _STATUS_REPORT_SQL)
def j4(spark, sf_dir):
    return _flat_report(_status_report(spark, sf_dir))


@query(
    "j5_report",
    sql("scored", f"""SELECT 'level' AS part, level AS name, count(*) AS n FROM scored GROUP BY 2
  UNION ALL (SELECT 'origin', origin, count(*) AS n FROM scored WHERE {_FLAGGED_SQL} GROUP BY 2 ORDER BY n DESC, 2 LIMIT 8)
  UNION ALL (SELECT 'line', line, count(*) FILTER (WHERE {_FLAGGED_SQL}) AS n FROM scored GROUP BY 2 ORDER BY n DESC, 2 LIMIT 8)
  UNION ALL (SELECT 'hs', hs, count(*) AS n FROM scored WHERE {_FLAGGED_SQL} GROUP BY 2 ORDER BY n DESC, 2 LIMIT 8)"""),
)
def j5(spark, sf_dir):
    tables = jobs.report_tables(derived.scored(spark, sf_dir))
    parts = [
        tables["level_breakdown"].select(F.lit("level").alias("part"), col("level").alias("name"), "n").where("n > 0"),
        tables["top_origins"].select(F.lit("origin").alias("part"), "name", "n"),
        tables["line_breakdown"].select(F.lit("line").alias("part"), "name", col("flagged").alias("n")),
        tables["hs_breakdown"].select(F.lit("hs").alias("part"), "name", "n"),
    ]
    return csv_source.union_inputs(parts)


@query("j6_frozen_scores", sql("explained", """SELECT Container_ID AS container_id, round(score * 100, 6) AS risk_score,
  risk_level, explanation_summary AS explanation, round(classifier_score, 6) AS classifier_score,
  round(anomaly_score, 6) AS anomaly_score FROM explained"""))
def j6(spark, sf_dir):
    rows = derived.unique(spark, sf_dir)
    fitted = profile.fit_profile(feature_ops.with_measures(derived.cleaned(spark, sf_dir)))
    fitted.medians = cleaning.unique_medians(rows)
    return rounded(jobs.score_rows_of(rows, ORDER, rule_columns, profile=fitted))


def _report_part(part: str, form: Callable[[DataFrame], DataFrame]):
    def run(spark, sf_dir):
        return form(jobs.report_tables(derived.scored(spark, sf_dir))[part])

    return run


def _container_part(part: str, form: Callable[[DataFrame], DataFrame]):
    def run(spark, sf_dir):
        rows = derived.scored(spark, sf_dir)
        return form(jobs.container_tables(rows, _some_id(rows))[part])

    return run


# the same SQL as that of the single report: the job's tables must be equal to them
_REPORT_PARTS = {
    "summary": ("a2_summary", rounded),
    "report_totals": ("a16_report_totals", rounded),
    "level_breakdown": ("a20_level_breakdown", lambda t: t.withColumns({"percent": r("percent"), "value_sum": r("value_sum", 2)})),
    "level_shares": ("a15_level_shares", rounded),
    "score_histogram": ("a9_score_histogram", lambda t: t),
    "top_origins": ("a10_top_origins", lambda t: t),
    "line_breakdown": ("a17_line_breakdown", rounded),
    "hs_breakdown": ("a18_hs_breakdown", lambda t: t),
    "value_at_risk": ("a19_value_at_risk", lambda t: rounded(t, 2)),
    "top_scores": ("a21_top_scores", lambda t: rounded(t.select("id", "level", "score", "rank"))),
}
for _part, (_same, _form) in _REPORT_PARTS.items():
    query(f"j5_{_part}", ORACLE[_same])(_report_part(_part, _form))
_OF_ONE_SQL = "SELECT * FROM ({}) WHERE id = (SELECT id FROM ({}))"
_CONTAINER_PARTS = {
    "container": (ORACLE["a22_lookup"], rounded),
    "rank": (ORACLE["a23_rank_of"], lambda t: t),
    "neighbours": (ORACLE["a24_neighbours_of"], lambda t: t),
    "peers": (ORACLE["a25_peers_of"], lambda t: t.select("id")),
    "radar": (_OF_ONE_SQL.format(ORACLE["a26_radar"], ORACLE["a22_lookup"]), rounded),
    "display_metrics": (
        _OF_ONE_SQL.format(ORACLE["a27_display_metrics"], ORACLE["a22_lookup"]),
        lambda t: t.withColumns({c: r(c) for c in ("weight_gap", "weight_gap_pct")}),
    ),
}
for _part, (_sql, _form) in _CONTAINER_PARTS.items():
    query(f"j5_{_part}", _sql)(_container_part(_part, _form))


# --- ST: streams ------------------------------------------------------------------------


@query("st1_score_stream", sql("explained", PREDICTION_SQL))
def st1(spark, sf_dir):
    rows = derived.unique(spark, sf_dir)
    source, target = stage_path(spark, "arrivals"), stage_path(spark, "st1")
    rows.write.parquet(source)
    fitted = profile.fit_profile(feature_ops.with_measures(derived.cleaned(spark, sf_dir)))
    fitted.medians = cleaning.unique_medians(rows)
    arriving = streams.read_stream(spark, source, rows.schema)
    predicted = streams.score_stream(arriving, fitted, rule_scores)
    streams.run_available(predicted, target, stage_path(spark, "st1-state"))
    return rounded(spark.read.parquet(target))


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


@query("st2_first_per_key", "SELECT DISTINCT 'U' || CAST(user_id AS VARCHAR) AS Container_ID FROM events")
def st2(spark, sf_dir):
    target = stage_path(spark, "st2")
    named = _event_stream(spark, sf_dir).select(
        F.concat(F.lit("U"), col("user_id").cast("string")).alias("Container_ID"), "ts", "event_type"
    )
    streams.run_available(
        streams.first_per_container(named, "ts", "3650 days"), target, stage_path(spark, "st2-state")
    )
    return spark.read.parquet(target).select("Container_ID")


#: Rows of an arriving file, about.
ARRIVAL_ROWS = 500_000


@query("st2_first_in_order", ORACLE["c3_deduplicate"])
def st2_in_order(spark, sf_dir):
    """C3 over files whose rows stand in no order; a row far in the future lets the watermark pass the others."""
    source, target, state = (stage_path(spark, n) for n in ("st2-arrivals", "st2-first", "st2-order"))
    rows = shipments(spark, sf_dir).withColumn("ts", col("Declaration_Date").cast("timestamp"))
    # files grow in number and not in size, so that more tasks write and read them; there are three micro-batches at any size
    fifth = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // (5 * ARRIVAL_ROWS)) or 1
    mixed = F.xxhash64("k_price", "k_part", "k_tax")
    with freed_shuffles(spark):
        rows.repartition(5 * fifth, mixed).write.parquet(source)
    arriving = streams.read_stream(spark, source, rows.schema, files_per_trigger=2 * fifth)
    first = streams.first_in_order(arriving, "ts", "3650 days", ORDER)
    streams.run_available(first, target, state, large_state=True)
    arrived = spark.read.schema(rows.schema).parquet(source)
    end = arrived.limit(1).withColumns({"Container_ID": F.lit("END"), "ts": F.lit("2100-01-01").cast("timestamp")})
    end.coalesce(1).write.mode("append").parquet(source)
    streams.run_available(first, target, state, large_state=True)
    return _ship_out(spark.read.schema(rows.schema).parquet(target).where("Container_ID <> 'END'"))


@query("st1_exactly_once", sql("explained", PREDICTION_SQL))
def st1_once(spark, sf_dir):
    """A scored stream whose micro-batches are all run a second time, as after a lost checkpoint."""
    rows = derived.unique(spark, sf_dir)
    source = stage_path(spark, "arrivals")
    third = -(-rows.count() // (3 * ARRIVAL_ROWS)) or 1  # files of each of the three micro-batches
    with freed_shuffles(spark):
        rows.repartition(3 * third, "Container_ID").write.parquet(source)
    fitted = profile.fit_profile(feature_ops.with_measures(derived.cleaned(spark, sf_dir)))
    fitted.medians = cleaning.unique_medians(rows)
    store = BatchStore(spark, stage_path(spark, "streamed"))
    for _ in range(2):
        arriving = streams.read_stream(spark, source, rows.schema, files_per_trigger=third)
        streams.store_batches(
            arriving, lambda batch: streams.score_stream(batch, fitted, rule_scores), store, "arrivals", stage_path(spark, "st1-once")
        )
    return rounded(store.committed("arrivals").drop("batch_id"))


@query(
    "st3_level_windows",
    "WITH e AS (SELECT date_trunc('day', ts) AS d, least(1, greatest(0, value / 100)) AS s FROM events),"
    " lev AS (SELECT *, CASE WHEN s >= 0.75 THEN 'Critical' WHEN s >= 0.5 THEN 'High' WHEN s >= 0.25 THEN 'Medium' ELSE 'Low' END"
    " AS level FROM e) SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(*) AS n, " + _LEVEL_COUNTS_SQL
    + ", round(avg(s * 100), 6) AS avg_score FROM lev GROUP BY d"
    " HAVING d + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)",
)
def st3(spark, sf_dir):
    target = stage_path(spark, "st3")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), col("value") / 100))
    scored = _event_stream(spark, sf_dir).select(
        "ts", (share * 100).alias("risk_score"), scoring.risk_level(share).alias("risk_level")
    )
    streams.run_available(streams.level_windows(scored, "ts"), target, stage_path(spark, "st3-state"))
    rows = spark.read.parquet(target)
    return rounded(rows.select(
        col("window_start").cast("date").cast("string").alias("day"), "n",
        *[v.lower() for v in K.LEVELS], "avg_score",
    ))


# --- D: described reports ---------------------------------------------------------------


@query(
    "d1_daily_trend",
    sql("scored", f"SELECT date, n, flagged, round(a, 6) AS avg_score, round(a - lag(a) OVER (ORDER BY date), 5) AS change FROM"
        f" (SELECT date, count(*) AS n, count(*) FILTER (WHERE {_FLAGGED_SQL}) AS flagged, avg(score) AS a FROM scored GROUP BY 1)"),
)
def d1(spark, sf_dir):
    rows = reports.daily_trend(derived.scored(spark, sf_dir))
    return rows.withColumns({"avg_score": r("avg_score"), "change": r("change", 5)})


@query(
    "d2_risky_routes",
    sql("scored", f"SELECT origin, port, count(*) AS n, count(*) FILTER (WHERE {_FLAGGED_SQL}) AS flagged,"
        f" round(sum(value), 2) AS value_sum, round(count(*) FILTER (WHERE {_FLAGGED_SQL}) * 100.0 / count(*), 6) AS rate"
        " FROM scored GROUP BY 1, 2 ORDER BY flagged DESC, origin, port LIMIT 20"),
)
def d2(spark, sf_dir):
    rows = reports.risky_routes(derived.scored(spark, sf_dir))
    return rows.withColumns({"value_sum": r("value_sum", 2), "rate": r("rate")})


@query("d3_json_export", sql("explained", PREDICTION_SQL))
def d3(spark, sf_dir):
    path = stage_path(spark, "d3")
    rows = derived.predictions(spark, sf_dir)
    sinks.write_json(rows, path)
    return rounded(spark.read.schema(rows.schema).json(path))


@query("d4_selected_ids", sql("explained", "SELECT Container_ID, round(score * 100, 2) AS Risk_Score, risk_level AS Risk_Level,"
       " explanation_summary AS Explanation FROM explained WHERE Container_ID IN (SELECT id FROM scored WHERE value > 80000)"
       .replace("SELECT id FROM scored WHERE value > 80000", "SELECT Container_ID FROM cleaned WHERE Declared_Value > 80000")))
def d4(spark, sf_dir):
    ids = derived.cleaned(spark, sf_dir).where(col("Declared_Value") > 80000).select("Container_ID")
    chosen = sinks.select_ids(derived.predictions(spark, sf_dir), ids)
    return sinks.predictions_export(chosen).withColumn("Risk_Score", col("Risk_Score").cast("double"))
