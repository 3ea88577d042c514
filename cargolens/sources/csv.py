"""Reading declaration files.

Columns are read as text and typed later, so no pass over the data infers a schema. Readers add
``ingest_file``, ``ingest_block`` and ``ingest_seq``, which order the rows as they stand in the
files and make "keep the first" well defined.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from functools import reduce
from io import StringIO

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.constants import (
    COUNTRY_COLUMNS,
    EMPTY_FIELDS,
    HISTORY_RENAMES,
    LINE_ENDS,
    NULL_TOKENS,
    TEXT_NO_EXPLANATION,
)
from cargolens.functions.columns import col, to_double
from cargolens.schema import SchemaError, canonical_names, normalize_columns
from cargolens.sources.records import first_lines, join_records, split_maps

INGEST_ORDER = ["ingest_file", "ingest_block", "ingest_seq"]
SURPLUS = "ingest_surplus"
INGEST_COLUMNS = [*INGEST_ORDER, SURPLUS]


def _ingest_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("ingest_file"),
        F.col("_metadata.file_block_start").alias("ingest_block"),
        F.monotonically_increasing_id().alias("ingest_seq"),
    ]


def blank_tokens(
    df: DataFrame,
    tokens: Iterable[str] = NULL_TOKENS,
    keep: dict[str, set[str]] | None = None,
) -> DataFrame:
    """Text cells that stand for a missing value become NULL (T4).

    ``keep`` lists tokens that are real values in a column. By default "NA" is kept in the
    country columns, where it is Namibia.
    """
    keep = {c: {"NA"} for c in COUNTRY_COLUMNS} if keep is None else keep
    cells = []
    for name, kind in df.dtypes:
        missing = [t for t in tokens if t not in keep.get(name, ())]
        usable = kind == "string" and name not in INGEST_COLUMNS
        cells.append(F.when(~col(name).isin(missing), col(name)).alias(name) if usable else col(name))
    return df.select(*cells)


def whole_number_codes(df: DataFrame, name: str = "HS_Code") -> DataFrame:
    """Codes as a reader that infers integers would give them: leading zeros are lost."""
    number = col(name).try_cast("bigint").cast("string")
    return df.withColumn(name, F.coalesce(number, col(name)))


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    null_tokens: Iterable[str] = NULL_TOKENS,
    hs_as_int: bool = False,
    line_breaks: bool = False,
) -> DataFrame:
    """Plain scan of files with one header line each.

    ``line_breaks`` says that quoted cells may hold line breaks; files stay splittable then too, and
    each file has its own header.
    """
    if line_breaks:
        line = F.regexp_replace("value", LINE_ENDS, "").alias("line")
        return _read_records(spark.read.text(path).select(line, *_ingest_columns()), null_tokens, hs_as_int)
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    df = normalize_columns(rows.select(*map(col, names), *_ingest_columns()))
    df = blank_tokens(df, null_tokens)
    return whole_number_codes(df) if hs_as_int and "HS_Code" in df.columns else df


def read_uploaded_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    null_tokens: Iterable[str] = NULL_TOKENS,
    hs_as_int: bool = False,
) -> DataFrame:
    """Defensive scan (S2): BOM, empty fields at line ends, blank lines, unnamed columns, quoted line breaks.

    Lines are cleaned before they are split into fields, so a trailing comma cannot shift the
    columns; a line break inside a quoted cell stays there as one line feed. The first record of each file is its header;
    all files are parsed in one scan, whatever their headers, and columns are brought together by name. A row
    with more fields than its header keeps the first surplus one in ``ingest_surplus``, by which C10 rejects it.
    A file that ends inside a quoted cell is an error.
    """
    tidy = F.regexp_replace(F.regexp_replace("value", LINE_ENDS, ""), EMPTY_FIELDS, "")
    return _read_records(spark.read.text(path).select(tidy.alias("line"), *_ingest_columns()), null_tokens, hs_as_int)


#: A task takes up to so many file splits, once there are so many for each core.
SPLITS = 64


def _several_splits(lines: DataFrame) -> DataFrame:
    """The same lines and splits; where files are cut into very many pieces, a task takes several of them in turn."""
    splits = lines.rdd.getNumPartitions()
    least = SPLITS * lines.sparkSession.sparkContext.defaultParallelism
    return lines.coalesce(max(least, -(-splits // SPLITS))) if splits > least else lines


def _read_records(lines: DataFrame, null_tokens: Iterable[str], hs_as_int: bool) -> DataFrame:
    """Lines of files, each with its header, as one table by column names."""
    lines = _several_splits(lines)
    maps = split_maps(lines)
    records, broken = join_records(lines, maps)
    place = F.struct("ingest_block", "ingest_seq")
    heads = records.groupBy("ingest_file").agg(
        F.min(place).alias("_head"), F.min_by("line", place).alias("_header")
    )
    found = [r[0] for r in heads.select("_header").distinct().collect()] if broken else first_lines(maps).values()
    headers = sorted(set(found))
    if not headers:
        raise SchemaError("the file has no header line")
    # one row for each file, which the driver lists itself
    numbered = F.array_position(F.array(*map(F.lit, headers)), col("_header")).cast("int") - 1
    heads = F.broadcast(heads.select("ingest_file", "_head", numbered.alias("_kind")))
    rows = records.join(heads, "ingest_file").where(place != col("_head"))
    parsed = _parsed(rows, [_header_names(h) for h in headers])
    df = blank_tokens(drop_blank_unnamed(parsed), null_tokens)
    own = [c for c in df.columns if c not in INGEST_COLUMNS]
    df = df.select(*map(col, own), *INGEST_COLUMNS)
    return whole_number_codes(df) if hs_as_int and "HS_Code" in df.columns else df


def _header_names(header: str) -> list[str]:
    """The columns of a header record under their fixed names."""
    cells = next(csv.reader(StringIO(header, newline="")))
    names = [name.replace(".", "_") if name.strip() else f"Unnamed: {i}" for i, name in enumerate(cells)]
    return canonical_names(names)


def _parsed(rows: DataFrame, headers: Sequence[Sequence[str]]) -> DataFrame:
    """Records of files with several headers as columns by name; ``_kind`` numbers a row's header.

    A record is split into as many cells as the widest header has, and one more; for each column a
    list by header says which cell it is.
    """
    width = max(map(len, headers)) + 1
    fields = ", ".join(f"c{i} string" for i in range(width))
    options = {"escape": '"', "maxColumns": str(max(20480, width))}
    cells = rows.select(F.from_csv("line", fields, options).alias("f"), "_kind", *INGEST_ORDER)
    cells = cells.select(F.array(*(F.col(f"f.c{i}") for i in range(width))).alias("_cells"), "_kind", *INGEST_ORDER)

    def cell(places: Sequence[int | None]) -> Column:
        same = len(set(places)) == 1
        return F.get("_cells", F.lit(places[0]) if same else F.get(F.array(*map(F.lit, places)), col("_kind")))

    names = list(dict.fromkeys(name for header in headers for name in header))
    named = [
        cell([header.index(name) if name in header else None for header in headers]).alias(name) for name in names
    ]
    surplus = F.nullif(F.trim(cell([len(header) for header in headers])), F.lit(""))
    return cells.select(*named, *INGEST_ORDER, surplus.alias(SURPLUS))


def with_row_numbers(df: DataFrame, name: str = "ingest_row") -> DataFrame:
    """The place of each row in its file, from 1, headers and blank lines not counted.

    Rows are numbered within their block of the file; blocks are shifted by the rows before them.
    """
    block = ["ingest_file", "ingest_block"]
    before = Window.partitionBy("ingest_file").orderBy("ingest_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(
        *block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    own = F.row_number().over(Window.partitionBy(*block).orderBy("ingest_seq"))
    return df.join(shifts, block).withColumn(name, own + col("_shift")).drop("_shift")


def drop_blank_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a header that hold nothing (S2); reads data only if there are any."""
    unnamed = [c for c in df.columns if c.strip().lower().startswith("unnamed")]
    if not unnamed:
        return df
    filled = df.agg(
        *[F.count_if(F.trim(F.coalesce(col(c), F.lit(""))) != "").alias(c) for c in unnamed]
    ).first()
    return df.drop(*[c for c in unnamed if filled[c] == 0])


def rename_history(df: DataFrame) -> DataFrame:
    """The fixed header renames of historical files."""
    return df.withColumnsRenamed({k: v for k, v in HISTORY_RENAMES.items() if k in df.columns})


def union_inputs(frames: Sequence[DataFrame]) -> DataFrame:
    """Several inputs by column name; columns that one lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def from_records(spark: SparkSession, records: Sequence[dict]) -> DataFrame:
    """A few records from the driver as a table (S5); headers may be in any accepted form."""
    names = list(dict.fromkeys(k for r in records for k in r))
    rows = [
        tuple(None if r.get(c) is None else str(r[c]) for c in names) + (i,)
        for i, r in enumerate(records)
    ]
    schema = T.StructType(
        [*[T.StructField(c, T.StringType()) for c in names], T.StructField("ingest_seq", T.LongType())]
    )
    return blank_tokens(normalize_columns(spark.createDataFrame(rows, schema)))


# --- fixed values: headers of scored files, in the order they are tried ------------------
SCORED_ALIASES = {
    "id": ["Container_ID", "id"],
    "score": ["Risk_Score", "score"],
    "level": ["Risk_Level", "level"],
    "origin": ["Origin_Country", "origin"],
    "value": ["Declared_Value", "value"],
    "dw": ["Declared_Weight", "dw"],
    "mw": ["Measured_Weight", "mw"],
    "dwell": ["Dwell_Time_Hours", "dwell"],
    "hs": ["HS_Code", "hs"],
    "line": ["Shipping_Line", "line"],
    "expl": ["Explanation_Summary", "expl"],
    "date": ["date", "Declaration_Date"],
}
SCORED_DEFAULTS = {
    "level": "Low", "origin": "N/A", "hs": "N/A", "line": "N/A", "expl": TEXT_NO_EXPLANATION, "date": "",
}
SCORED_NUMBERS = ["score", "value", "dw", "mw", "dwell"]


def scored_rows(df: DataFrame) -> DataFrame:
    """Rows of an already scored file under the report's column names, with defaults.

    A row without id is named by ``ingest_row``, its place in its file.
    """
    out = []
    for name, aliases in SCORED_ALIASES.items():
        found = [F.nullif(F.trim(col(a)), F.lit("")) for a in aliases if a in df.columns]
        text = F.coalesce(*found) if found else F.lit(None).cast("string")
        if name in SCORED_NUMBERS:
            out.append(F.coalesce(to_double(text), F.lit(0.0)).alias(name))
        elif name == "id":
            place = F.concat(F.lit("ROW_"), col("ingest_row").cast("string"))
            out.append(F.coalesce(text, place).alias(name))
        else:
            out.append(F.coalesce(text, F.lit(SCORED_DEFAULTS[name])).alias(name))
    return df.select(*out)


def read_scored_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Reader for already scored files."""
    return scored_rows(with_row_numbers(read_uploaded_csv(spark, path, null_tokens=[""])))
