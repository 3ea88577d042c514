"""Training and applying the classifier with Spark ML, beside the isolation forest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.columns import col, draw60
from cargolens.operators.boosting import BoostedTrees
from cargolens.operators.descent import Descent, fit_descent
from cargolens.operators.features import available_features
from cargolens.operators.forest import (
    Forest,
    fit_forest,
    isolation_score,
    scaled_anomaly,
    score_bounds,
)
from cargolens.operators.labels import guard_single_class
from cargolens.operators.metrics import binary_metrics, class_report, roc_auc
from cargolens.operators.selection import order_statistic_of_groups
from cargolens.plans.staging import stage


def feature_matrix(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Feature columns as doubles without NULLs; the other columns stay (M1)."""
    names = list(features or available_features(df))
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in names})


def split_draw(id_col: str = "Container_ID", seed: int = 42) -> Column:
    """Repeatable number in [0, 1) per row."""
    return draw60(id_col, seed) / float(1 << 60)


def split(
    df: DataFrame, test_share: float = 0.2, *, id_col: str = "Container_ID", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by hash of the id (M2).

    The draw does not depend on the label, so each class is split in the same proportion; no
    shuffle takes place and a re-run gives the same rows.
    """
    held_out = split_draw(id_col, seed) < test_share
    return df.where(~held_out), df.where(held_out)


def stratified_split(
    df: DataFrame,
    label: str = "label",
    test_share: float = 0.2,
    *,
    id_col: str = "Container_ID",
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the same share of each class, to the row (M2).

    Of the n rows of a class the round(share * n) with the lowest draws are held out (halves go up); their
    highest draw is found exactly for all classes in the same few passes over the narrow column, so
    rows are not sorted or moved. Rows with one id stay together; rows without a label are trained on.
    """
    draw = draw60(id_col, seed)
    cuts = order_statistic_of_groups(df, col(label), draw, lambda n: int(test_share * n + 0.5) - 1)
    held_out = F.lit(False)
    for value, cut in cuts.items():
        held_out = F.when(col(label) == value, draw <= cut).otherwise(held_out)
    held_out = F.coalesce(held_out, F.lit(False))
    return df.where(~held_out), df.where(held_out)


def scaler(input_col: str = "assembled", output_col: str = "features") -> StandardScaler:
    """Standard scaling to mean 0 and deviation 1 (M3); Spark's own, with the sample deviation."""
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)


def balanced_weights(df: DataFrame, label: str = "label") -> dict[int, float]:
    """n / (classes * rows of the class) for the classes 0 and 1 (M4)."""
    counts = df.agg(F.count_if(col(label) == 0).alias("0"), F.count_if(col(label) == 1).alias("1"))
    found = {int(k): n for k, n in counts.first().asDict().items() if n}
    return {k: sum(found.values()) / (len(found) * n) for k, n in found.items()}


def with_class_weight(df: DataFrame, weights: dict[int, float], label: str = "label") -> DataFrame:
    """Add the weight of each row's class (M4)."""
    weight = F.lit(None).cast("double")
    for value, w in weights.items():
        weight = F.when(col(label) == value, w).otherwise(weight)
    return df.withColumn("class_weight", weight)


def boosted_trees(
    features: Sequence[str], *, max_iter: int = 200, label: str = "label", seed: int = 42
) -> Pipeline:
    """Gradient-boosted trees (M5); trees need no scaling."""
    return Pipeline(stages=[BoostedTrees(features, label=label, rounds=max_iter, depth=4, rate=0.08, share=0.8, seed=seed)])


def logistic(
    features: Sequence[str],
    *,
    max_iter: int = 500,
    label: str = "label",
    reg: float = 0.0,
    weighted: bool = False,
) -> Pipeline:
    """Scaled logistic regression (M6); class weights only on request."""
    fitter = LogisticRegression(labelCol=label, maxIter=max_iter, regParam=reg)
    if weighted:
        fitter = fitter.setWeightCol("class_weight")
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="assembled"), scaler(), fitter
        ]
    )


def scale_table(train_rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each feature over the rows a model is fitted on (M3)."""
    sums = train_rows.agg(
        *[F.avg(col(c)).alias(f"{c}_mean") for c in features],
        *[F.stddev_pop(col(c)).alias(f"{c}_deviation") for c in features],
    )
    rows = [F.struct(F.lit(c).alias("feature"), col(f"{c}_mean").alias("mean"), col(f"{c}_deviation").alias("deviation")) for c in features]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def loss_history(model: PipelineModel) -> list[float]:
    """Objective per iteration of a fitted logistic regression (M6)."""
    return list(model.stages[-1].summary.objectiveHistory)


def sigmoid_score(coefficients: dict[str, float], intercept: float) -> Column:
    """Logistic probability as a plain expression over the scaled columns (M6)."""
    z = F.lit(intercept)
    for name, weight in coefficients.items():
        z = z + col(name) * weight
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))
    return 1 / (1 + F.exp(-z))


@dataclass
class RiskModel:
    """Classifier, forest and what was learned about them."""

    classifier: PipelineModel
    forest: Forest
    features: list[str]
    stats: dict = field(default_factory=dict)
    bounds: tuple[float, float] | None = None


def classifier_scores(df: DataFrame, model: RiskModel) -> DataFrame:
    """Probability of class 1, within [0, 1]."""
    extra = ["assembled", "features", "rawPrediction", "probability", "prediction"]
    scored = model.classifier.transform(feature_matrix(df, model.features))
    own = "classifier_score" in scored.columns  # a model by gradient descent gives the number itself
    chance = col("classifier_score") if own else vector_to_array(col("probability"))[1]
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance))
    return scored.withColumn("classifier_score", chance).drop(*extra)


def raw_scores(df: DataFrame, model: RiskModel) -> DataFrame:
    """Classifier probability and raw isolation score per row."""
    return classifier_scores(df, model).withColumn("isolation", isolation_score(model.forest))


def predict_scores(
    df: DataFrame,
    model: RiskModel,
    bounds: tuple[float, float] | None = None,
    *,
    keep: Sequence[str] | None = None,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Both scores of every row (M9, M10), beside the columns in ``keep`` or all.

    Without ``bounds`` the anomaly score is scaled over this batch, so the raw scores are staged
    and the Python walk runs once. With bounds from fitting the plan stays lazy.
    """
    scored = raw_scores(df, model)
    if keep is not None:
        scored = scored.select(*keep, "classifier_score", "isolation")
    if bounds is None:
        scored = staging(scored, "scores")
        bounds = score_bounds(scored) or (0.0, 0.0)
    return scored.withColumn("anomaly_score", scaled_anomaly(col("isolation"), bounds)).drop(
        "isolation"
    )


def train(
    df: DataFrame,
    label: str = "label",
    *,
    use_logistic: bool = False,
    use_descent: bool = False,
    exact_split: bool = False,
    use_balanced_weights: bool = True,
    test_share: float = 0.2,
    max_iter: int | None = None,
    trees: int = 100,
    seed: int = 42,
    flip_single_class: bool = False,
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> RiskModel:
    """Fit classifier and forest on 80 percent and measure on the rest.

    ``use_descent`` fits the logistic model by full-batch gradient descent on scaled features, without
    class weights; ``exact_split`` holds out the same share of each class to the row.
    The assembled matrix is staged, since fitting reads it many times. ``bounds`` of the model
    are the lowest and highest isolation score of all rows, for frozen scoring.
    """
    features = available_features(df)
    matrix = feature_matrix(df, features).select("Container_ID", label, *features)
    if flip_single_class:
        matrix = guard_single_class(matrix, label, seed=seed)
    matrix = staging(matrix.withColumn("_draw", split_draw(seed=seed)), "matrix")
    if exact_split:
        train_rows, test_rows = stratified_split(matrix, label, test_share, seed=seed)
    else:
        train_rows, test_rows = matrix.where(col("_draw") >= test_share), matrix.where(col("_draw") < test_share)
    weights = balanced_weights(train_rows, label) if use_balanced_weights else {0: 1.0, 1: 1.0}
    weighted = with_class_weight(train_rows, weights, label)
    if use_logistic:
        recipe = logistic(features, max_iter=max_iter or 500, label=label)
    else:
        recipe = boosted_trees(features, max_iter=max_iter or 200, label=label, seed=seed)
    fitted: Descent | None = None
    if use_descent:
        scales = {r["feature"]: (r["mean"], r["deviation"]) for r in scale_table(train_rows, features).collect()}
        fitted = fit_descent(train_rows, features, label, steps=max_iter or 500, scales=scales)
    model = RiskModel(
        fitted.pipeline() if fitted else recipe.fit(weighted), fit_forest(train_rows, features, trees=trees, seed=seed), features
    )
    model.bounds = score_bounds(matrix.select(isolation_score(model.forest).alias("isolation")))
    judged = staging(
        classifier_scores(test_rows, model).select(
            col(label).alias("label"), col("classifier_score").alias("score")
        ),
        "judged",
    ).withColumn("prediction", (col("score") >= 0.5).cast("int"))
    model.stats = {
        **binary_metrics(judged).first().asDict(),
        "auc": roc_auc(judged, staging=staging).first()["roc_auc"],
        "report": [r.asDict() for r in class_report(judged).collect()],
        "train_size": train_rows.count(),
        "test_size": test_rows.count(),
        "n_features": len(features),
        "class_weights": weights,
    }
    if fitted:
        model.stats["losses"] = fitted.losses
    return model
