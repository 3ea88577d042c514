"""Writing tables, exports and reports.

Every sink writes a folder in parallel, one file per task. Only one-row reports use one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.constants import EXPORT_COLUMNS, OPTIONAL_COLUMNS, REPORT_COLUMNS, REQUIRED_COLUMNS
from cargolens.functions.columns import col, fixed
from cargolens.plans.staging import freed_shuffles


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled inside quoted fields."""
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def predictions_export(predictions: DataFrame) -> DataFrame:
    """Four columns with the score at two decimals."""
    return predictions.select(
        col("container_id").alias(EXPORT_COLUMNS[0]),
        fixed(col("risk_score"), 2).alias(EXPORT_COLUMNS[1]),
        col("risk_level").alias(EXPORT_COLUMNS[2]),
        col("explanation_summary").alias(EXPORT_COLUMNS[3]),
    )


def report_export(scored: DataFrame) -> DataFrame:
    """Eleven columns of the full report; double quotes in texts become single ones."""
    sources = ["id", "score", "level", "origin", "value", "dw", "mw", "dwell", "hs", "line"]
    return scored.select(
        *[col(s).alias(n) for s, n in zip(sources, REPORT_COLUMNS)],
        F.translate(F.coalesce(col("expl"), F.lit("")), '"', "'").alias(REPORT_COLUMNS[-1]),
    )


def canonical_columns(df: DataFrame) -> DataFrame:
    """Required columns and the optional ones that are present, NULL as empty text."""
    names = REQUIRED_COLUMNS + [c for c in OPTIONAL_COLUMNS if c in df.columns]
    empty = F.lit(None).cast("string")
    cells = [(col(c).cast("string") if c in df.columns else empty) for c in names]
    return df.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cells, names)])


def write_canonical_csv(df: DataFrame, path: str) -> None:
    """Rewrite an upload under canonical headers."""
    cells = canonical_columns(df)
    cells.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task (D3)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def select_ids(df: DataFrame, ids: DataFrame, column: str = "container_id") -> DataFrame:
    """Rows whose id is in a list (D4). The list is a table, so it may be of any length."""
    wanted = ids.select(col(ids.columns[0]).cast("string").alias(column))
    return df.join(wanted, column, "left_semi")
