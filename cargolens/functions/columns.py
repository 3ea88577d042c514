"""Small column expressions shared by the operators. All of them stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def to_double(c: str | Column) -> Column:
    """Number or NULL. NaN becomes NULL, since Spark would order it above every number."""
    number = col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_date(c: str | Column, formats: Iterable[str] = ()) -> Column:
    """Date or NULL; tries the ISO form first and then each given pattern."""
    parsed = [F.try_to_timestamp(col(c).cast("string"))]
    parsed += [F.try_to_timestamp(col(c).cast("string"), F.lit(f)) for f in formats]
    return F.coalesce(*parsed).cast("date")


def hour_of(c: str | Column) -> Column:
    """Hour in front of the first colon, 12 when there is none."""
    return F.coalesce(F.split(col(c).cast("string"), ":")[0].try_cast("int"), F.lit(12))


def in_classes(c: Column, high: list[str], medium: list[str]) -> Column:
    """2 for a code in ``high``, else 1 for one in ``medium``, else 0."""
    return F.when(c.isin(high), 2).when(c.isin(medium), 1).otherwise(0)


def fixed(c: Column, digits: int, grouping: bool = False) -> Column:
    """Number as text; ties go to the even digit as Python formats them."""
    pattern = f"%{',' if grouping else ''}.{digits}f"
    return F.format_string(pattern, F.bround(c, digits))


def fill_text(template: str, *parts: Column) -> Column:
    """``template`` with each %s replaced; NULL when any part is NULL."""
    pieces = template.replace("%%", "%").split("%s")
    out = [F.lit(pieces[0])]
    for part, tail in zip(parts, pieces[1:], strict=True):
        out += [part, F.lit(tail)]
    return F.concat(*out)


def level_rank(c: str | Column) -> Column:
    """Position of a level in severity order, 4 for an unknown level."""
    from cargolens.constants import LEVELS

    return F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(LEVELS) for x in (v, i)]), col(c)),
        F.lit(len(LEVELS)),
    )


def draw60(id_col: str | Column, seed: int) -> Column:
    """A repeatable number from 0 to 2^60 - 1 per id, from the MD5 digest that SQL engines share."""
    text = F.concat(col(id_col).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
