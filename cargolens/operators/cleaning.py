"""Validation and cleaning of declaration tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.constants import (
    CRITICAL_COLUMNS,
    MEASURES,
    NUMERIC_NAME_PARTS,
    RANGE_LIMITS,
    UNKNOWN,
)
from cargolens.functions.columns import col, to_date, to_double
from cargolens.operators.selection import exact_median
from cargolens.plans.staging import stage
from cargolens.schema import normalize_columns, require_schema

ID = "Container_ID"


# --- C2, C12: types ---------------------------------------------------------------------


def standardize(df: DataFrame, date_formats: Iterable[str] = ()) -> DataFrame:
    """Canonical headers, date and numeric types; values that do not parse become NULL."""
    df = normalize_columns(df)
    typed = {}
    for name, kind in df.dtypes:
        if name == "Declaration_Date":
            parsed = kind in ("date", "timestamp", "timestamp_ntz")
            typed[name] = col(name).cast("date") if parsed else to_date(name, date_formats)
        elif any(part in name.lower() for part in NUMERIC_NAME_PARTS):
            typed[name] = to_double(name)
    return df.select(*[typed.get(c, col(c)).alias(c) for c in df.columns])


def standardize_history(df: DataFrame, date_formats: Iterable[str] = ()) -> DataFrame:
    """Types for historical files: id and commodity code as text, then as in C2."""
    df = normalize_columns(df)
    texts = {c: col(c).cast("string") for c in (ID, "HS_Code") if c in df.columns}
    measures = {c: to_double(c) for c in MEASURES if c in df.columns}
    dates = {c: to_date(c, date_formats) for c in ["Declaration_Date"] if c in df.columns}
    return df.withColumns({**texts, **measures, **dates})


# --- C3: duplicates ---------------------------------------------------------------------


def _order(order_cols: Sequence[str | Column]) -> list[Column]:
    return [col(c) for c in order_cols]


def remove_duplicates(df: DataFrame, order_cols: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per container in the given order.

    The rank limit lets Spark cut each key to one row *before* the shuffle, so a container id
    that fills a third of the table sends one row per input split.
    """
    if ID not in df.columns:
        return df
    order = _order(order_cols) or [F.lit(1)]
    rank = F.row_number().over(Window.partitionBy(ID).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


# --- C4-C7: missing values and ranges ---------------------------------------------------


def _critical(columns: Iterable[str]) -> list[str]:
    present = set(columns)
    return [c for c in CRITICAL_COLUMNS if c in present]


def drop_missing_critical(df: DataFrame) -> DataFrame:
    """Drop rows without id, value or a weight (C4), and those with more fields than their header."""
    kept = df.where(col("ingest_surplus").isNull()) if "ingest_surplus" in df.columns else df
    return kept.na.drop(subset=_critical(df.columns))


def numeric_medians(
    df: DataFrame, columns: Sequence[str], *, exact: bool = True
) -> dict[str, float]:
    """Median of each column; ``exact=False`` takes one pass with quantile sketches for all."""
    if not columns:
        return {}
    if exact:
        found = {c: exact_median(df, col(c).cast("double")) for c in columns}
    else:
        sketches = [F.percentile_approx(col(c).cast("double"), 0.5).alias(c) for c in columns]
        found = df.agg(*sketches).first().asDict()
    return {c: m for c, m in found.items() if m is not None}


def _fillable(df: DataFrame, extra_numeric: Sequence[str]) -> list[str]:
    """Columns that can still hold NULLs after the critical ones were checked."""
    wanted = [c for c in MEASURES if c not in CRITICAL_COLUMNS] + list(extra_numeric)
    return [c for c in wanted if c in df.columns]


def unique_medians(
    unique: DataFrame, extra_numeric: Sequence[str] = (), *, exact: bool = True
) -> dict[str, float]:
    """Medians that C5 fills in, from rows that are already one per container."""
    rows = drop_missing_critical(unique)
    return numeric_medians(rows, _fillable(rows, extra_numeric), exact=exact)


def fill_numeric(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Replace NULL numbers by the given medians."""
    return df.withColumns({c: F.coalesce(col(c), F.lit(m)) for c, m in medians.items()})


def fill_categorical(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Replace NULL text by a constant."""
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in skip]
    return df.na.fill(UNKNOWN, texts)


def in_ranges(
    columns: Iterable[str],
    limits: Mapping[str, tuple] = RANGE_LIMITS,
    medians: Mapping[str, float] | None = None,
) -> Column:
    """True when every limited column lies within its inclusive limits.

    ``medians`` are put in for NULLs, as if the rows had been filled before.
    """
    checks = []
    for name, (low, high) in limits.items():
        if name not in columns:
            continue
        value = col(name)
        if medians and name in medians:
            value = F.coalesce(value, F.lit(medians[name]))
        checks += [value >= low] if low is not None else []
        checks += [value <= high] if high is not None else []
    return reduce(and_, checks, F.lit(True))


def filter_ranges(df: DataFrame, limits: Mapping[str, tuple] = RANGE_LIMITS) -> DataFrame:
    """Keep rows within the limits; a NULL measure fails."""
    return df.where(in_ranges(df.columns, limits))


# --- C8: the whole cleaning -------------------------------------------------------------


@dataclass(frozen=True)
class CleanOptions:
    """What a job can set about cleaning; the defaults are those of the single steps."""

    date_formats: tuple[str, ...] = ()
    limits: Mapping[str, tuple] = field(default_factory=lambda: RANGE_LIMITS)
    extra_numeric: tuple[str, ...] = ()
    keep_null: tuple[str, ...] = ()
    exact: bool = True


def prepare_rows(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    *,
    strict: bool = True,
    date_formats: Iterable[str] = (),
) -> DataFrame:
    """Typed rows, one per container."""
    if strict:
        require_schema(df)
    return remove_duplicates(standardize(df, date_formats), order_cols)


def finish_rows(
    unique: DataFrame,
    medians: Mapping[str, float],
    *,
    limits: Mapping[str, tuple] = RANGE_LIMITS,
    keep_null: Sequence[str] = (),
) -> DataFrame:
    """C4-C7 with known medians; a chain of narrow steps."""
    filled = fill_numeric(drop_missing_critical(unique), medians)
    return filter_ranges(fill_categorical(filled, keep_null), limits)


def clean(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    *,
    strict: bool = True,
    limits: Mapping[str, tuple] = RANGE_LIMITS,
    medians: Mapping[str, float] | None = None,
    extra_numeric: Sequence[str] = (),
    keep_null: Sequence[str] = (),
    exact: bool = True,
    date_formats: Iterable[str] = (),
    staging: Callable[[DataFrame, str], DataFrame] = stage,
) -> DataFrame:
    """Full cleaning in the order C1, C2, C3, C4, C5, C6, C7.

    With ``medians`` given the result is one lazy plan. Otherwise the de-duplicated rows are
    staged, since both the medians and the result read them.
    """
    unique = prepare_rows(df, order_cols, strict=strict, date_formats=date_formats)
    if medians is None:
        unique = staging(drop_missing_critical(unique), "unique")
        medians = unique_medians(unique, extra_numeric, exact=exact)
    return finish_rows(unique, medians, limits=limits, keep_null=keep_null)


# --- C9, C10: what was removed and why --------------------------------------------------


def _missing_reason(columns: Sequence[str]) -> Column:
    missing = reduce(or_, [col(c).isNull() for c in _critical(columns)])
    # a row with more fields than its header: its values may stand in the wrong columns
    surplus = col("ingest_surplus").isNotNull() if "ingest_surplus" in columns else F.lit(False)
    return F.when(surplus, "surplus_fields").when(missing, "missing_critical")


def _range_reason(
    columns: Sequence[str], medians: Mapping[str, float], limits: Mapping[str, tuple]
) -> Column:
    good = F.coalesce(in_ranges(columns, limits, medians), F.lit(False))
    return F.when(~good, "invalid_range")


def _reject_reason(
    columns: Sequence[str], medians: Mapping[str, float], limits: Mapping[str, tuple]
) -> Column:
    return F.coalesce(_missing_reason(columns), _range_reason(columns, medians, limits))


#: Container ids are counted in so many buckets; rows of a bucket with more than ``CROWDED`` rows may share one id.
BUCKETS, CROWDED = 1 << 16, 50_000


def tag_rows(df: DataFrame, order_cols: Sequence[str], *, unique_order: bool = False) -> DataFrame:
    """Standardised rows with ``copies`` and what C3 and C4 say of them in ``reject_reason``.

    Rows move once, by container, and are sorted there: the first one is kept, exact copies are one
    row that says how many there are in ``copies``. A kept row with copies appears twice: once as
    kept, once for the copies that were dropped. Rows whose id may fill a large part of the table
    go another way, which splits them.

    ``unique_order`` says that no two rows agree in ``order_cols``, as with the ingest columns
    of the readers. There are no exact copies then.
    """
    bucket = F.pmod(F.hash(col(ID)), F.lit(BUCKETS))
    sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    # one number per bucket: the size bound of this broadcast is BUCKETS
    crowded = F.broadcast(sizes.where(F.col("_rows") > CROWDED).select("_bucket"))
    few = df.join(crowded, bucket == F.col("_bucket"), "left_anti")
    many = df.join(crowded, bucket == F.col("_bucket"), "left_semi")
    return _tag_sorted(few, order_cols, unique_order).unionByName(_tag_split(many, order_cols, unique_order))


def _tags(columns: Sequence[str], is_first: Column, rows: Column) -> Column:
    """``copies`` and ``reject_reason`` of ``rows`` equal rows, as one or two lines."""

    def part(copies: Column, why: Column) -> Column:
        return F.struct(copies.cast("long").alias("copies"), why.cast("string").alias("reject_reason"))

    kept, duplicate = part(F.lit(1), _missing_reason(columns)), F.lit("duplicate")
    return F.inline(
        F.when(is_first & (rows > 1), F.array(kept, part(rows - 1, duplicate)))
        .when(is_first, F.array(kept))
        .otherwise(F.array(part(rows, duplicate)))
    )


def _ties(columns: Sequence[str], order_cols: Sequence[str]) -> list[Column]:
    return [col(c) for c in columns if c not in order_cols and c != ID]


def _tag_sorted(df: DataFrame, order_cols: Sequence[str], unique_order: bool) -> DataFrame:
    """``tag_rows`` by one shuffle and one sort; all rows of an id meet in one task."""
    columns = df.columns
    order = [*_order(order_cols), *([] if unique_order else _ties(columns, order_cols))]
    places = Window.partitionBy(ID).orderBy(*order)
    rows = df.withColumn("_rank", F.rank().over(places))  # equal rows have one rank
    n = F.lit(1)
    if not unique_order:
        same = Window.partitionBy(ID, *order)
        rows = rows.withColumn("_place", F.row_number().over(places))
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(same)).where("_place = _rank")
        n = F.col("_n")
    return rows.select(*map(col, columns), _tags(columns, F.col("_rank") == 1, n))


def _tag_split(df: DataFrame, order_cols: Sequence[str], unique_order: bool) -> DataFrame:
    """``tag_rows`` for ids that many rows share.

    Exact copies are counted once before anything moves, so a row repeated over a third of the table
    is one row from there on. The first row of each container comes from a partial aggregate, and
    the rows meet it through an equi-join whose big side AQE can split.
    """
    columns = df.columns
    if unique_order:
        ties, rows = [], df.withColumn("_n", F.lit(1).cast("long"))
    else:
        ties = _ties(columns, order_cols)
        rows = df.groupBy(*map(col, columns)).agg(F.count(F.lit(1)).alias("_n"))
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*_order(order_cols), *ties])])
    first = rows.groupBy(col(ID).alias("_id")).agg(F.min(place).alias("_first"))
    matched = rows.join(first, col(ID).eqNullSafe(F.col("_id")))
    return matched.select(*map(col, columns), _tags(columns, place.eqNullSafe(F.col("_first")), F.col("_n")))


def tagged_medians(
    tagged: DataFrame, extra_numeric: Sequence[str] = (), *, exact: bool = True
) -> dict[str, float]:
    """Medians that C5 fills in, from tagged rows; these should be staged, several passes read them."""
    rows = tagged.where(col("reject_reason").isNull())
    return numeric_medians(rows, _fillable(rows, extra_numeric), exact=exact)


def judge_rows(
    tagged: DataFrame, medians: Mapping[str, float], *, limits: Mapping[str, tuple] = RANGE_LIMITS
) -> DataFrame:
    """Tagged rows with the final ``reject_reason``: what C7 says of those that are left."""
    reason = F.coalesce(col("reject_reason"), _range_reason(tagged.columns, medians, limits))
    return tagged.withColumn("reject_reason", reason)


def reject_reasons(
    df: DataFrame,
    order_cols: Sequence[str],
    medians: Mapping[str, float],
    *,
    limits: Mapping[str, tuple] = RANGE_LIMITS,
    unique_order: bool = False,
) -> DataFrame:
    """Every input row with the reason it failed, NULL for a good one."""
    return judge_rows(tag_rows(df, order_cols, unique_order=unique_order), medians, limits=limits)


def cleaned_of(
    judged: DataFrame, medians: Mapping[str, float], *, keep_null: Sequence[str] = ()
) -> DataFrame:
    """The rows of C8 from judged ones: the good ones, filled."""
    good = judged.where(col("reject_reason").isNull()).drop("copies", "reject_reason")
    return fill_categorical(fill_numeric(good, medians), keep_null)


#: Counters of C9 and the reasons that they count.
REASON_COUNTS = {
    "duplicates_removed": ("duplicate",),
    "rows_with_missing_critical": ("missing_critical", "surplus_fields"),
    "invalid_value_ranges": ("invalid_range",),
}


def stored_accounting(rejects: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The row of C9 from what a batch has stored: two narrow columns of its rejects, and the number of cleaned rows.

    (Observing the rows as they are written would save this pass, but a session that has observed anything
    can no longer apply a logistic model: Spark 4.1 then fails to serialise the model's summary.)
    """
    counts = [
        F.coalesce(F.sum(F.when(col("reject_reason").isin(*reasons), col("copies"))), F.lit(0).cast("long")).alias(name)
        for name, reasons in REASON_COUNTS.items()
    ]
    found = rejects.agg(*counts, cleaned.agg(F.count(F.lit(1))).scalar().alias("rows_valid"))
    failed = sum((col(name) for name in list(REASON_COUNTS)[1:]), col(next(iter(REASON_COUNTS))))
    return found.select(
        F.when(col("rows_valid") > 0, "success").otherwise("partial_success").alias("status"),
        (failed + col("rows_valid")).alias("rows_received"),
        "rows_valid",
        failed.alias("rows_failed"),
        *REASON_COUNTS,
    )


def row_accounting(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    medians: Mapping[str, float],
    *,
    limits: Mapping[str, tuple] = RANGE_LIMITS,
) -> DataFrame:
    """One row of counters over standardised rows: received, valid, failed and why.

    One pass: partial aggregates count the rows of each id and keep the first one's reason, and the
    ids are counted. A table that lacks required columns gives status "schema_error" and no counts.
    """
    lacking = [c for c in CRITICAL_COLUMNS if c not in df.columns]
    if lacking:
        counts = df.select(F.lit(0).alias("n")).limit(0).agg(F.count("n").alias("n"))
        names = ["rows_valid", "duplicates_removed", "rows_with_missing_critical", "invalid_value_ranges"]
        received = df.agg(F.count(F.lit(1))).scalar()
        return counts.select(
            F.lit("schema_error").alias("status"),
            received.alias("rows_received"),
            *[F.lit(None).cast("long").alias(c) for c in names[:1]],
            received.alias("rows_failed"),
            *[F.lit(None).cast("long").alias(c) for c in names[1:]],
        )
    reason = _reject_reason(df.columns, medians, limits)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order(order_cols))])
    ids = df.groupBy(ID).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(place.alias("p"), reason.alias("r")))["r"].alias("reason")
    )
    judged = ids.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("received"),
        F.count(F.lit(1)).alias("unique"),
        F.count_if(F.col("reason").isin("missing_critical", "surplus_fields")).alias("missing"),
        F.count_if(F.col("reason") == "invalid_range").alias("invalid"),
    )
    valid = F.col("unique") - F.col("missing") - F.col("invalid")
    return judged.select(
        F.when(valid > 0, "success").otherwise("partial_success").alias("status"),
        F.col("received").alias("rows_received"),
        valid.alias("rows_valid"),
        (F.col("received") - valid).alias("rows_failed"),
        (F.col("received") - F.col("unique")).alias("duplicates_removed"),
        F.col("missing").alias("rows_with_missing_critical"),
        F.col("invalid").alias("invalid_value_ranges"),
    )


def clean_medians(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    *,
    extra_numeric: Sequence[str] = (),
    exact: bool = True,
) -> dict[str, float]:
    """Medians that C8 would fill in, from standardised rows."""
    return unique_medians(remove_duplicates(df, order_cols), extra_numeric, exact=exact)


# --- C11, C13 ---------------------------------------------------------------------------


def preview(df: DataFrame) -> DataFrame:
    """Rows, distinct origins and two means over raw rows; text that is no number counts 0 (C11)."""
    origin = F.when(col("Origin_Country") != "", col("Origin_Country"))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(origin).alias("unique_origins"),
        F.coalesce(
            F.avg(F.coalesce(to_double("Declared_Value"), F.lit(0.0))), F.lit(0.0)
        ).alias("avg_value"),
        F.coalesce(
            F.avg(F.coalesce(to_double("Dwell_Time_Hours"), F.lit(0.0))), F.lit(0.0)
        ).alias("avg_dwell"),
    )


def preview_sample(df: DataFrame, order_cols: Sequence[str | Column], rows: int = 3) -> DataFrame:
    """The first rows of an upload, as shown beside the preview (C11)."""
    return df.orderBy(*_order(order_cols)).limit(rows)


def readable_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label could be read."""
    return df.where(col(label).isNotNull())
