"""Declared schemas and header mapping.

Header work happens on column *names* only, so none of it starts a Spark job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cargolens.constants import MEASURES, MISSING_FIELD, REQUIRED_COLUMNS

SHIPMENT_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.DoubleType()
            if name in MEASURES
            else T.DateType()
            if name == "Declaration_Date"
            else T.StringType(),
        )
        for name in REQUIRED_COLUMNS
    ]
)

RAW_SHIPMENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_COLUMNS])

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("container_id", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("explanation_summary", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("classifier_score", T.DoubleType()),
        T.StructField("anomaly_score", T.DoubleType()),
    ]
)
PREDICTION_COLUMNS = PREDICTION_SCHEMA.names


class SchemaError(ValueError):
    """Raised when a table cannot be mapped to the declared schema."""


def normalize_header(name: str) -> str:
    """Lower-case a header; drop a BOM and bracketed notes; unify ``-``, blanks and ``_``."""
    bare = re.sub(r"\s*\([^)]*\)\s*", "", name.replace("\ufeff", "").strip())
    return re.sub(r"[-_ ]+", "_", bare).strip("_").lower()


_CANONICAL = {normalize_header(c): c for c in REQUIRED_COLUMNS}


def header_mapping(columns: Iterable[str]) -> dict[str, str]:
    """Map every recognised header to its canonical column name."""
    known = ((c, _CANONICAL.get(normalize_header(c))) for c in columns)
    return {c: target for c, target in known if target}


def canonical_names(columns: Iterable[str]) -> list[str]:
    """Trimmed headers, the recognised ones under their fixed names.

    Two headers that would end up with one name are an error: Spark could not address them.
    """
    columns = list(columns)
    mapping = header_mapping(columns)
    targets = [mapping.get(c, c.replace("\ufeff", "").strip()) for c in columns]
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        raise SchemaError(f"Several headers map to one column: {twice}")
    return targets


def normalize_columns(df: DataFrame) -> DataFrame:
    """The table under its ``canonical_names``."""
    return df.toDF(*canonical_names(df.columns))


def missing_fields(columns: Iterable[str]) -> list[str]:
    """Messages for required columns that no header maps to."""
    found = set(header_mapping(columns).values())
    return [MISSING_FIELD % c for c in REQUIRED_COLUMNS if c not in found]


def require_schema(df: DataFrame) -> DataFrame:
    """Normalise the headers and raise when a required column is absent."""
    problems = missing_fields(df.columns)
    if problems:
        raise SchemaError(f"Schema validation failed: {problems}")
    return normalize_columns(df)
