"""User-level jobs that tie the operators together."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.constants import ANOMALY_WEIGHT, CLASSIFIER_WEIGHT
from cargolens.functions.columns import col
from cargolens.operators import reports
from cargolens.operators.cleaning import (
    CleanOptions,
    clean,
    clean_medians,
    cleaned_of,
    finish_rows,
    judge_rows,
    prepare_rows,
    readable_labels,
    row_accounting,
    standardize,
    standardize_history,
    stored_accounting,
    tag_rows,
    tagged_medians,
    unique_medians,
)
from cargolens.operators.explain import INPUTS
from cargolens.operators.features import engineer_features, with_measures
from cargolens.operators.labels import (
    label_fallback,
    label_history,
    label_retrain,
    normalize_labels,
    numeric_labels,
)
from cargolens.operators.metrics import evaluation_report, evaluation_rows, predict_at
from cargolens.operators.models import RiskModel, predict_scores, train
from cargolens.operators.profile import Profile, fit_profile
from cargolens.operators.scoring import blend_weights, score_rows, to_predictions
from cargolens.plans.staging import Staging, stage
from cargolens.schema import missing_fields, require_schema
from cargolens.sources.csv import INGEST_COLUMNS, INGEST_ORDER, from_records, read_uploaded_csv, rename_history
from cargolens.sources.sinks import write_csv, write_report_json
from cargolens.sources.store import BatchStore, ModelStore


def prepare_history(df: DataFrame, label: str = "is_risky") -> DataFrame:
    """Raw history to a labelled table, lazily."""
    return label_history(standardize_history(rename_history(df)), label)


def prepare_files(spark: SparkSession, source: str, target: str) -> None:
    """J1 from CSV files to a CSV folder."""
    labelled = prepare_history(read_uploaded_csv(spark, source))
    write_csv(labelled.drop(*INGEST_COLUMNS), target)


def _labelled(features: DataFrame, label: str, rules: str) -> tuple[DataFrame, str]:
    if label in features.columns:
        return numeric_labels(features, label), label
    make = {"fallback": label_fallback, "retrain": label_retrain}[rules]
    return make(features, "label"), "heuristic_generated"


@dataclass
class TrainedRun:
    model: RiskModel
    profile: Profile
    report: dict


def train_model(
    df: DataFrame,
    order_cols: Sequence,
    *,
    label: str = "is_risky",
    rules: str = "fallback",
    weights: tuple[float, float] = (CLASSIFIER_WEIGHT, ANOMALY_WEIGHT),
    store: ModelStore | None = None,
    report_path: str = "",
    cleaning: CleanOptions = CleanOptions(),
    **options,
) -> TrainedRun:
    """Clean, build features, label, fit, measure and save.

    ``rules`` picks the labels for a table without a label column. The profile that comes back
    holds the statistics and anomaly bounds of this table for frozen scoring.
    """
    blend = blend_weights(*weights)
    spark = df.sparkSession
    with Staging(spark) as staging:
        rows = prepare_rows(df, order_cols, strict=False, date_formats=cleaning.date_formats)
        unique = staging(rows, "unique")
        medians = unique_medians(unique, cleaning.extra_numeric, exact=cleaning.exact)
        kept = finish_rows(unique, medians, limits=cleaning.limits, keep_null=cleaning.keep_null)
        cleaned = staging(kept, "cleaned")
        profile = fit_profile(with_measures(cleaned))  # it outlives the job's staged tables
        profile.medians = medians
        features = engineer_features(cleaned, profile)
        labelled, label_source = _labelled(features, label, rules)
        model = train(labelled, "label", staging=staging, **options)
        profile.anomaly_bounds = model.bounds
        report = {
            "label_column": label_source,
            "rows_after_cleaning": model.stats["train_size"] + model.stats["test_size"],
            "feature_count": len(model.features),
            "risk_scorer_weights": {"classifier_weight": blend[0], "anomaly_weight": blend[1]},
            "validation_metrics": {k: v for k, v in model.stats.items() if k != "class_weights"},
        }
        if store is not None:
            report["run_id"] = store.save(model, profile)
        if report_path:
            write_report_json(spark.createDataFrame([_report_row(report)]), report_path)
    return TrainedRun(model, profile, report)


def _report_row(report: dict):
    from pyspark.sql import Row

    def row(value):
        if isinstance(value, dict):
            return Row(**{k: row(v) for k, v in value.items()})
        return [row(v) for v in value] if isinstance(value, list) else value

    return row(report)


Scorer = Callable[[DataFrame], DataFrame]


def _both_scores(
    features: DataFrame,
    model: RiskModel | Scorer,
    bounds: tuple[float, float] | None,
    keep: Sequence[str],
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Classifier and anomaly score from a trained model, or from a function that adds both."""
    if isinstance(model, RiskModel):
        return predict_scores(features, model, bounds, keep=keep, staging=staging)
    return model(features).select(*keep, "classifier_score", "anomaly_score")


def score_table(
    df: DataFrame,
    order_cols: Sequence,
    model: RiskModel | Scorer,
    store: BatchStore,
    *,
    profile: Profile | None = None,
    weights: tuple[float, float] | None = None,
    batch_id: str | None = None,
    cleaning: CleanOptions = CleanOptions(),
) -> str:
    """Clean and score a table and store the batch; returns the batch id.

    Without a profile the statistics are those of this batch. The input is read once and written
    as typed rows; one tagged table of them says what C3 and C4 drop, and rejects and cleaned rows are
    filters of it, from which the counters come. Cleaned rows and predictions are
    written once each, and everything behind them reads those tables. ``model`` may also be a
    function that adds classifier_score and anomaly_score to feature rows. The batch also holds
    the row counters (C9), the rejected rows with their reasons (C10) and the rows per clearance
    status (A4); a table that lacks required columns leaves the counters and raises.
    """
    batch_id = batch_id or uuid.uuid4().hex[:8]
    bounds = profile.anomaly_bounds if profile else None
    with Staging(df.sparkSession) as staging:
        rows = standardize(df, cleaning.date_formats)
        if missing_fields(df.columns):
            store.write_accounting(row_accounting(rows, order_cols, {}), batch_id)
        require_schema(df)
        typed = staging(rows, "typed")
        tagged = staging(tag_rows(typed, order_cols, unique_order=list(order_cols) == INGEST_ORDER), "tagged")
        medians = profile.medians if profile and profile.medians else None
        if medians is None:
            medians = tagged_medians(tagged, cleaning.extra_numeric, exact=cleaning.exact)
        judged = judge_rows(tagged, medians, limits=cleaning.limits)
        store.write_rejects(judged.where("reject_reason IS NOT NULL"), batch_id)
        store.write_cleaned(cleaned_of(judged, medians, keep_null=cleaning.keep_null), batch_id)
        cleaned = store.cleaned(batch_id)
        store.write_accounting(stored_accounting(store.rejects(batch_id), cleaned), batch_id)
        features = engineer_features(cleaned, profile, staging=staging)
        keep = [c for c in ("Container_ID", "ingest_seq") if c in features.columns]
        both = _both_scores(features, model, bounds, [*keep, *INPUTS], staging)
        scored = score_rows(both, weights)
        store.write_predictions(to_predictions(scored), batch_id)
    stored = store.predictions(batch_id).select(
        col("risk_level").alias("level"), col("risk_score").alias("score"), "anomaly_score"
    )
    store.write_summary(reports.summary_record(stored), batch_id)
    if "Clearance_Status" in cleaned.columns:
        store.write_statuses(reports.clearance_distribution(cleaned), batch_id)
    return batch_id


def evaluate(
    df: DataFrame,
    order_cols: Sequence,
    model: RiskModel | Scorer,
    *,
    label: str = "is_risky",
    threshold: float = 0.5,
    weights: tuple[float, float] | None = None,
    rows_path: str = "",
    report_path: str = "",
    cleaning: CleanOptions = CleanOptions(),
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> tuple[DataFrame, DataFrame]:
    """Report and row-level table for a labelled input."""
    if label not in df.columns:
        raise ValueError(f"label column {label!r} not found; there are {', '.join(df.columns)}")
    labelled = normalize_labels(df, label)
    if readable_labels(labelled, "label").limit(1).count() == 0:
        raise ValueError(f"no label in column {label!r} could be read")
    cleaned = staging(
        clean(
            readable_labels(labelled, "label"), order_cols, strict=False, staging=staging,
            **vars(cleaning),
        ),
        "cleaned",
    )
    features = engineer_features(cleaned, staging=staging)
    both = _both_scores(features, model, None, ["Container_ID", "label"], staging)
    scored = score_rows(both, weights)
    report = evaluation_report(labelled, scored, threshold=threshold, staging=staging)
    rows = evaluation_rows(predict_at(scored, threshold))
    if rows_path:
        write_csv(rows, rows_path)
    if report_path:
        write_report_json(report, report_path)
    return report, rows


def report_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """All summary tables over scored shipments, which should be stored or staged once."""
    return {
        "summary": reports.summary(scored),
        "report_totals": reports.report_totals(scored),
        "level_breakdown": reports.level_breakdown(scored),
        "level_shares": reports.level_shares(scored),
        "score_histogram": reports.score_histogram(scored),
        "top_origins": reports.top_origins(scored),
        "line_breakdown": reports.line_breakdown(scored),
        "hs_breakdown": reports.hs_breakdown(scored),
        "value_at_risk": reports.value_at_risk(scored),
        "top_scores": reports.top_scores(scored),
        "first_page": reports.page(scored, 1),
        "daily_trend": reports.daily_trend(scored),
        "risky_routes": reports.risky_routes(scored),
    }


def container_tables(scored: DataFrame, container_id: str) -> dict[str, DataFrame]:
    """What the report shows about one container."""
    one = reports.find_container(scored, container_id)
    return {
        "container": one,
        "rank": reports.rank_of(scored, container_id),
        "neighbours": reports.neighbours_of(scored, container_id),
        "peers": reports.peers_of(scored, container_id),
        "radar": reports.radar(one),
        "display_metrics": reports.display_metrics(one),
    }


def score_rows_of(
    rows: DataFrame,
    order_cols: Sequence,
    model: RiskModel | Scorer,
    *,
    profile: Profile | None = None,
    weights: tuple[float, float] | None = None,
    cleaning: CleanOptions = CleanOptions(),
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Score standardised rows with the statistics of a profile, or their own.

    Cleaned rows are staged, since they are looked at before they are scored and would be moved twice.
    """
    medians = (profile.medians if profile else None) or clean_medians(
        rows, order_cols, extra_numeric=cleaning.extra_numeric, exact=cleaning.exact
    )
    cleaned = staging(
        clean(
            rows, order_cols, strict=False, medians=medians, limits=cleaning.limits,
            keep_null=cleaning.keep_null, date_formats=cleaning.date_formats,
        ),
        "cleaned",
    )
    if cleaned.limit(1).count() == 0:
        raise ValueError("no record is valid after cleaning")
    features = engineer_features(cleaned, profile)
    bounds = profile.anomaly_bounds if profile else None
    keep = [c for c in ("Container_ID", "ingest_seq") if c in features.columns]
    scored = score_rows(_both_scores(features, model, bounds, [*keep, *INPUTS]), weights)
    return to_predictions(scored).select(
        F.coalesce("container_id", F.lit("UNKNOWN")).alias("container_id"),
        "risk_score", "risk_level", col("explanation_summary").alias("explanation"),
        "classifier_score", "anomaly_score",
    )


def score_records(
    spark: SparkSession,
    records: Sequence[dict],
    model: RiskModel | Scorer,
    *,
    profile: Profile | None = None,
    weights: tuple[float, float] | None = None,
    cleaning: CleanOptions = CleanOptions(),
) -> DataFrame:
    """Score a few records from the driver.

    Without a profile, statistics come from these records alone, as T11 and T13 describe.
    """
    rows = standardize(from_records(spark, records), cleaning.date_formats)
    return score_rows_of(
        rows, ["ingest_seq"], model, profile=profile, weights=weights, cleaning=cleaning
    )
