"""Summaries and lookups over scored rows (A1-A29) and daily and route reports.

Input columns follow ``scored_shipments``: id, score (0-100), level, origin, port, value, dw, mw,
dwell, hs, line, expl, date. Reports with few result rows are one conditional aggregate; top-k
reports use ``orderBy().limit()``, which keeps k rows per task. Level spines have four rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens import constants as K
from cargolens.functions.columns import col, flag, in_classes, level_rank
from cargolens.operators.cleaning import remove_duplicates
from cargolens.operators.ordering import with_neighbours, with_rank
from cargolens.plans.staging import stage

TOP = 8
PER_PAGE = 20
#: Rows up to which a page is cut from the head of the order.
NEAR_ROWS = 1000
#: Parts that the rows of one origin and level are dealt over.
PEER_SALTS = 64


def _count() -> Column:
    return F.count(F.lit(1))


def flagged(level: str = "level") -> Column:
    """Critical or High."""
    return col(level).isin(K.FLAGGED_LEVELS)


def by_score() -> list[Column]:
    """Highest score first; the id breaks ties."""
    return [F.desc("score"), F.asc("id")]


# --- A28: predictions beside the declared attributes ------------------------------------


_ATTRIBUTES = [
    "Origin_Country", "Destination_Port", "Declared_Value", "Declared_Weight", "Measured_Weight",
    "Dwell_Time_Hours", "HS_Code", "Shipping_Line", "Declaration_Date",
]


def attribute_rows(
    raw: DataFrame, *, keep: str = "first", order_cols: Sequence[str | Column] | None = None
) -> DataFrame:
    """One row of attributes per trimmed id, in ``_id``, with defaults for gaps.

    ``keep="last"`` takes the last raw row of an id in ``order_cols`` (T21); without them the
    order is that of the attributes themselves. Raw rows are cut to one per trimmed id before the
    shuffle. Raw ids may stand in Container_ID, container_id or id; the first that is not NULL counts.
    """
    names = [c for c in ("Container_ID", "container_id", "id") if c in raw.columns]
    found = F.trim(F.coalesce(*[col(c).cast("string") for c in names]))
    raw = raw.withColumn("_key", found).drop(*names).withColumnRenamed("_key", "Container_ID")
    raw = raw.where(col("Container_ID") != "")
    order = [col(c) for c in order_cols or [c for c in _ATTRIBUTES if c in raw.columns]]
    raw = remove_duplicates(raw, [c.desc() for c in order] if keep == "last" else order)
    has = set(raw.columns)

    def text(name: str, default: str) -> Column:
        if name not in has:
            return F.lit(default)
        value = col(name).cast("string")
        return F.coalesce(F.when(value != "", value), F.lit(default))

    def number(name: str) -> Column:
        value = col(name).try_cast("double") if name in has else F.lit(None).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))

    return raw.select(
        col("Container_ID").alias("_id"),
        text("Origin_Country", "N/A").alias("origin"),
        text("Destination_Port", "N/A").alias("port"),
        number("Declared_Value").alias("value"),
        number("Declared_Weight").alias("dw"),
        number("Measured_Weight").alias("mw"),
        number("Dwell_Time_Hours").alias("dwell"),
        text("HS_Code", "N/A").alias("hs"),
        text("Shipping_Line", "N/A").alias("line"),
        text("Declaration_Date", "").alias("date"),
    )


def with_attribute_defaults(joined: DataFrame) -> DataFrame:
    """Predictions beside their ``attribute_rows`` under the report's names; those without one get defaults."""
    absent = {"origin": "N/A", "port": "N/A", "hs": "N/A", "line": "N/A", "date": ""}
    absent |= {"value": 0.0, "dw": 0.0, "mw": 0.0, "dwell": 0.0}
    return joined.na.fill(absent).select(
        F.trim(col("container_id")).alias("id"),
        F.coalesce(col("risk_score"), F.lit(0.0)).alias("score"),
        F.coalesce(col("risk_level"), F.lit("Low")).alias("level"),
        "origin", "port", "value", "dw", "mw", "dwell", "hs", "line",
        F.coalesce(col("explanation_summary"), F.lit(K.TEXT_NO_EXPLANATION)).alias("expl"),
        "date",
        F.coalesce(col("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(col("classifier_score"), F.lit(0.0)).alias("classifier_score"),
        F.coalesce(col("anomaly_score"), F.lit(0.0)).alias("anomaly_score"),
    )


def attach_attributes(
    predictions: DataFrame,
    raw: DataFrame,
    *,
    keep: str = "first",
    order_cols: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Left-join predictions to raw rows on the trimmed id, with defaults for gaps.

    The join meets at most one row per key of ``attribute_rows`` and repeats no prediction.
    """
    facts = attribute_rows(raw, keep=keep, order_cols=order_cols)
    return with_attribute_defaults(predictions.join(facts, F.trim(col("container_id")) == col("_id"), "left"))


# --- A1-A6: batch summary ---------------------------------------------------------------


def level_spine(df: DataFrame) -> DataFrame:
    """The four levels in severity order."""
    rows = ", ".join(f"('{v}', {i})" for i, v in enumerate(K.LEVELS))
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(level, level_order)")


def group_sizes(df: DataFrame) -> DataFrame:
    """Rows and score range per level, with all four levels present (A1)."""
    sizes = df.groupBy("level").agg(
        _count().alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score")
    )
    # at most one aggregate row per level meets the four-row spine
    return level_spine(df).join(sizes, "level", "left").na.fill(0, ["n"])


def group_by_level(df: DataFrame) -> DataFrame:
    """Rows laid out by level, as the batch store writes them (A1).

    Rows of unknown levels are dropped. Large groups stay rows: nothing gathers a level into
    one value, and a level that holds most rows is cut by the score range as well.
    """
    known = df.where(col("level").isin(K.LEVELS)).withColumn("level_order", level_rank("level"))
    return known.repartitionByRange(F.col("level_order"), *by_score()).sortWithinPartitions(
        "level_order", *by_score()
    )


def _level_counts() -> list[Column]:
    return [F.count_if(col("level") == v).alias(v.lower()) for v in K.LEVELS]


def summary(df: DataFrame) -> DataFrame:
    """Totals, level counts, anomalies and mean score; zeros for an empty table."""
    return df.agg(
        _count().alias("total_containers"),
        *_level_counts(),
        F.count_if(col("anomaly_score") > K.ANOMALY_CUTOFF).alias("anomalies"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_risk_score"),
    )


def summary_record(df: DataFrame) -> DataFrame:
    """The nested summary of a batch: counts and level map.

    Clearance statuses are free text, so their counts stay rows: ``clearance_distribution``.
    """
    levels = F.create_map(*[x for v in K.LEVELS for x in (F.lit(v.lower()), col(v.lower()))])
    return summary(df).withColumn("risk_distribution", levels)


def clearance_distribution(df: DataFrame) -> DataFrame:
    """Rows per clearance status (A4)."""
    status = F.coalesce(col("Clearance_Status").cast("string"), F.lit(K.UNKNOWN))
    return df.groupBy(status.alias("clearance_status")).agg(_count().alias("n")).orderBy(F.desc("n"))


def priority_order(df: DataFrame) -> DataFrame:
    """Most severe level first, then highest score (A5). A range sort over all tasks."""
    return df.orderBy(level_rank("level"), *by_score())


# --- A7-A15: dashboard ------------------------------------------------------------------


def level_distribution(df: DataFrame) -> DataFrame:
    """Rows per level, empty levels left out."""
    known = df.where(col("level").isin(K.LEVELS))
    return known.groupBy("level").agg(_count().alias("n"))


def top_risk_factors(df: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent feature flags."""
    flags = [c for c in K.FEATURES if c.startswith("flag_") and c in df.columns]
    sums = df.agg(*[F.sum(c).cast("long").alias(c) for c in flags])
    pairs = ", ".join(f"'{c}', `{c}`" for c in flags)
    long = sums.select(F.expr(f"stack({len(flags)}, {pairs}) AS (factor, n)"))
    return long.where(col("n") > 0).orderBy(F.desc("n"), "factor").limit(top)


def score_histogram(df: DataFrame) -> DataFrame:
    """Ten buckets of ten points, the last one closed, empty ones kept."""
    bucket = F.least(F.lit(9), F.floor(col("score") / 10)).cast("int")
    counts = df.groupBy(bucket.alias("bucket")).agg(_count().alias("n"))
    spine = df.sparkSession.range(10).select(col("id").cast("int").alias("bucket"))
    label = F.concat((col("bucket") * 10).cast("string"), F.lit("-"), (col("bucket") * 10 + 9).cast("string"))
    return spine.join(counts, "bucket", "left").select(
        "bucket", label.alias("range"), F.coalesce(col("n"), F.lit(0)).alias("n")
    )


def top_origins(df: DataFrame, top: int = TOP) -> DataFrame:
    """Origins with the most flagged rows (A10)."""
    counts = df.where(flagged()).groupBy(col("origin").alias("name")).agg(_count().alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(top)


def filter_level(df: DataFrame, level: str = "All") -> DataFrame:
    """Rows of one level, or all rows."""
    return df if level == "All" else df.where(col("level") == level)


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows whose id, origin, line or commodity code contains the text."""
    if not text:
        return df
    wanted = F.lit(text.lower())
    return df.where(
        F.lower("id").contains(wanted)
        | F.lower("origin").contains(wanted)
        | F.lower("line").contains(wanted)
        | col("hs").contains(wanted)
    )


def sort_by(df: DataFrame, key: str = "score") -> DataFrame:
    """Descending by score, value or dwell."""
    if key not in ("score", "value", "dwell"):
        raise ValueError(f"unknown sort key: {key}")
    return df.orderBy(F.desc(key), F.asc("id"))


def page(df: DataFrame, number: int, key: str = "score", per_page: int = PER_PAGE) -> DataFrame:
    """One page of the sorted rows.

    The first pages come from a top-k; a page behind ``NEAR_ROWS`` rows is found by rank, so the
    driver never holds the rows before it.
    """
    start = (number - 1) * per_page
    if start + per_page <= NEAR_ROWS:
        return sort_by(df, key).offset(start).limit(per_page)
    order = [F.desc(key), F.asc("id")]
    ranked = with_rank(df, order, "_place")
    return sort_by(ranked.where(col("_place").between(start + 1, start + per_page)), key).drop("_place")


def page_after(
    df: DataFrame, last_value: float, last_id: str, key: str = "score", per_page: int = PER_PAGE
) -> DataFrame:
    """The page behind a given row; the cost does not grow with the page number."""
    behind = (col(key) < last_value) | ((col(key) == last_value) & (col("id") > last_id))
    return sort_by(df.where(behind), key).limit(per_page)


def page_count(df: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Rows and number of pages."""
    return df.agg(
        _count().alias("total"), F.ceil(_count() / F.lit(per_page)).cast("long").alias("pages")
    )


def level_shares(df: DataFrame) -> DataFrame:
    """Rows and percent per level."""
    counts = level_spine(df).join(level_distribution(df), "level", "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())
    share = F.coalesce(F.try_divide(col("n") * 100.0, total), F.lit(0.0))
    return counts.select("level", "n", share.alias("percent"))


# --- A16-A21: report --------------------------------------------------------------------


def report_totals(df: DataFrame) -> DataFrame:
    """Totals, levels, score range, flagged rows and their rate."""
    rate = F.try_divide(F.count_if(flagged()) * 100.0, _count())
    return df.agg(
        _count().alias("total"),
        *_level_counts(),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.min("score"), F.lit(0.0)).alias("min_score"),
        F.count_if(flagged()).alias("flagged"),
        F.coalesce(rate, F.lit(0.0)).alias("flag_rate"),
    )


def line_breakdown(df: DataFrame, top: int = TOP) -> DataFrame:
    """Shipping lines with the most flagged rows."""
    named = df.where((col("line") != "") & (col("line") != "N/A"))
    counts = named.groupBy(col("line").alias("name")).agg(
        _count().alias("total"), F.count_if(flagged()).alias("flagged")
    )
    rate = (col("flagged") * 100.0 / col("total")).alias("rate")
    return counts.select("*", rate).orderBy(F.desc("flagged"), "name").limit(top)


def hs_breakdown(df: DataFrame, top: int = TOP) -> DataFrame:
    """Commodity codes with the most flagged rows."""
    named = df.where(flagged() & (col("hs") != "") & (col("hs") != "N/A"))
    counts = named.groupBy(col("hs").alias("name")).agg(_count().alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(top)


def value_at_risk(df: DataFrame) -> DataFrame:
    """Declared value on flagged rows."""
    total = F.sum(F.when(flagged(), col("value")))
    return df.agg(F.coalesce(total, F.lit(0.0)).alias("value_at_risk"))


def level_breakdown(df: DataFrame) -> DataFrame:
    """Rows, percent and declared value per level."""
    sums = df.groupBy("level").agg(_count().alias("n"), F.sum("value").alias("value_sum"))
    rows = level_spine(df).join(sums, "level", "left").na.fill({"n": 0, "value_sum": 0.0})
    total = F.sum("n").over(Window.partitionBy())
    share = F.coalesce(F.try_divide(col("n") * 100.0, total), F.lit(0.0))
    return rows.select("level", "n", share.alias("percent"), "value_sum")


def top_scores(df: DataFrame, top: int = 10) -> DataFrame:
    """The highest scores with their rank; only ``top`` rows are numbered."""
    best = df.orderBy(*by_score()).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*by_score())))


# --- A22-A27: one container -------------------------------------------------------------


def find_container(df: DataFrame, container_id: str) -> DataFrame:
    """Point lookup."""
    return df.where(col("id") == container_id)


def rank_all(df: DataFrame, *, staging: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """Rank of every container by score."""
    return with_rank(df.select("id", "score"), by_score(), staging=staging)


def _own_place(df: DataFrame, container_id: str) -> Column:
    """(-score, id) of one container as a scalar subquery; NULL when it is absent."""
    place = F.struct((-col("score")).alias("s"), col("id").alias("i"))
    return find_container(df, container_id).select(place).limit(1).scalar()


def rank_of(df: DataFrame, container_id: str) -> DataFrame:
    """Rank of one container, 0 when absent: one aggregate against its place."""
    own = _own_place(df, container_id)
    place = F.struct((-col("score")).alias("s"), col("id").alias("i"))
    rows = df.select((place < own).alias("ahead"), (place == own).alias("same"))
    found = F.count_if("same") > 0
    return rows.agg(
        F.lit(container_id).alias("id"),
        F.when(found, F.count_if("ahead") + 1).otherwise(0).alias("rank"),
    )


def neighbours_of(df: DataFrame, container_id: str) -> DataFrame:
    """Containers just before and after one container in score order."""
    place = F.struct((-col("score")).alias("s"), col("id").alias("i"))
    rows = df.select(place.alias("place"), _own_place(df, container_id).alias("own"))
    before = F.max(F.when(col("place") < col("own"), col("place")))
    after = F.min(F.when(col("place") > col("own"), col("place")))
    return rows.agg(
        F.lit(container_id).alias("id"), before["i"].alias("prev_id"), after["i"].alias("next_id")
    )


def neighbours_all(
    df: DataFrame, *, staging: Callable[[DataFrame, str], DataFrame] = stage
) -> DataFrame:
    """Rank, previous and next container of every container."""
    found = with_neighbours(df.select("id", "score"), by_score(), "id", staging=staging)
    return found.select("id", "rank", "prev_id", "next_id")


def peers_of(df: DataFrame, container_id: str, top: int = 5) -> DataFrame:
    """First containers of the same origin and level; none for a Low one."""
    own = find_container(df, container_id).where(col("level") != "Low")
    group = own.select(F.struct("origin", "level")).limit(1).scalar()
    same = df.where((F.struct("origin", "level") == group) & (col("id") != container_id))
    return same.orderBy(*by_score()).limit(top)


def peers_all(df: DataFrame, top: int = 5) -> DataFrame:
    """Peers of every container above Low.

    The first ``top + 1`` rows of each origin and level are ranked; the rank limit cuts each
    group before the shuffle. A row then meets only those, never its whole group. A group's list is
    copied to ``PEER_SALTS`` salts and rows pick one by a hash of their id, so the rows of a hot
    group are dealt over that many tasks.
    """
    risky = df.where(col("level") != "Low")
    place = F.row_number().over(Window.partitionBy("origin", "level").orderBy(*by_score()))
    heads = (
        risky.select("origin", "level", "id", "score")
        .withColumn("place", place)
        .where(col("place") <= top + 1)
        .select("origin", "level", col("id").alias("peer_id"), "place")
    )
    # one list of at most top + 1 ids per group, so the join keeps one row per container
    lists = heads.groupBy("origin", "level").agg(
        F.sort_array(F.collect_list(F.struct("place", "peer_id"))).alias("heads")
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(PEER_SALTS - 1))).alias("salt")
    dealt = risky.select("id", "origin", "level", F.pmod(F.hash("id"), F.lit(PEER_SALTS)).alias("salt"))
    joined = dealt.join(lists.select("*", salts), ["origin", "level", "salt"])
    others = F.slice(F.filter("heads", lambda h: h["peer_id"] != col("id")), 1, top)
    return joined.select("id", "origin", "level", F.posexplode(others).alias("pos", "peer")).select(
        "id", "origin", "level", (col("pos") + 1).alias("place"), "peer.peer_id"
    )


def radar(df: DataFrame) -> DataFrame:
    """Five factors from 0 to 100 per container in long form."""
    has_weight = col("dw") > 0
    gap = F.when(has_weight, (col("mw") - col("dw")) / col("dw") * 100).otherwise(0.0)
    density = F.when(has_weight, col("value") / col("dw")).otherwise(0.0)
    origin = in_classes(
        col("origin"), K.CHART_HIGH_RISK_COUNTRIES, K.CHART_MEDIUM_RISK_COUNTRIES
    )
    wide = df.select(
        "id",
        F.least(F.lit(100.0), F.abs(gap)).alias("weight"),
        F.least(F.lit(100.0), F.log1p(density) * 8).alias("density"),
        col("score").alias("risk"),
        F.least(F.lit(100.0), col("dwell") / 200 * 100).alias("dwell"),
        F.when(origin == 2, 90.0).when(origin == 1, 55.0).otherwise(15.0).alias("origin"),
    )
    return wide.select(
        "id",
        F.expr(
            "stack(5, 'Weight gap', weight, 'Value/kg', density, 'Risk Score', risk,"
            " 'Dwell Time', dwell, 'Origin Risk', origin) AS (factor, value)"
        ),
    )


def display_metrics(df: DataFrame) -> DataFrame:
    """Derived figures of the detail view and which of them stand out."""
    declared = F.when(col("dw") > 0, col("dw"))
    gap = col("mw") - col("dw")
    pct = gap / declared * 100
    density = col("value") / declared
    return df.select(
        "id",
        density.alias("value_per_kg"),
        gap.alias("weight_gap"),
        pct.alias("weight_gap_pct"),
        flag(density > 500).alias("high_density"),
        flag((col("dwell") > 72) | (col("dwell") < 2)).alias("odd_dwell"),
        flag(F.abs(gap) > 1000).alias("large_gap"),
        flag(F.abs(pct) > 20).alias("large_gap_pct"),
    )


def sample_head(df: DataFrame, order_cols: Sequence[str | Column], rows: int = 5) -> DataFrame:
    """First scored rows with shortened text, as the training log shows them."""
    return df.orderBy(*[col(c) for c in order_cols]).limit(rows).select(
        "id", "level", "score", F.substring("expl", 1, 60).alias("expl")
    )


# --- D1, D2 -----------------------------------------------------------------------------


def daily_trend(df: DataFrame) -> DataFrame:
    """Rows, flagged rows and mean score per day, and the change against the day before.

    The window runs over one row per calendar day.
    """
    days = df.where(col("date") != "").groupBy("date").agg(
        _count().alias("n"), F.count_if(flagged()).alias("flagged"), F.avg("score").alias("avg_score")
    )
    before = F.lag("avg_score").over(Window.orderBy("date"))
    return days.withColumn("change", col("avg_score") - before)


def risky_routes(df: DataFrame, top: int = 20) -> DataFrame:
    """Routes with the most flagged rows."""
    routes = df.groupBy("origin", "port").agg(
        _count().alias("n"), F.count_if(flagged()).alias("flagged"), F.sum("value").alias("value_sum")
    )
    rate = (col("flagged") * 100.0 / col("n")).alias("rate")
    return routes.select("*", rate).orderBy(F.desc("flagged"), "origin", "port").limit(top)
