"""Exact order statistics without sorting a table or holding it in one task.

Each round runs one aggregate over the column: an approximate quantile sketch gives two values
that surely enclose the wanted ranks, and only rows between them stay candidates. Every round
shrinks the candidates by a factor of about 1,000 whatever the distribution, and a value that
many rows share closes the interval at once. The last step reads at most ``limit`` distinct
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
COLLECT_LIMIT = 100_000


def _sketch(values: DataFrame, low_share: float, high_share: float, slack: float):
    shares = [max(0.0, low_share - slack), min(1.0, high_share + slack)]
    return values.agg(
        F.count("v").alias("rows"),
        F.approx_count_distinct("v").alias("distinct"),
        F.percentile_approx("v", shares, SKETCH_ACCURACY).alias("around"),
    ).first()


def order_statistics(
    df: DataFrame, value: Column, share: float, ranks_of, *, limit: int = COLLECT_LIMIT
) -> list | None:
    """Values at 0-based ranks near ``share``; ``ranks_of(n)`` gives the ranks for ``n`` rows.

    NULLs are left out. Returns None when the column has no value at all.
    """
    values = df.select(value.alias("v")).where(F.col("v").isNotNull())
    slack = 2.0 / SKETCH_ACCURACY
    seen = _sketch(values, share, share, slack)
    if not seen["rows"]:
        return None
    ranks = list(ranks_of(seen["rows"]))
    below, size = 0, seen["rows"]
    while seen["distinct"] > limit:
        low, high = seen["around"]
        counts = values.agg(
            F.count_if(F.col("v") < low).alias("under"),
            F.count_if(F.col("v").between(low, high)).alias("kept"),
        ).first()
        start = below + counts["under"]
        if start <= min(ranks) and max(ranks) < start + counts["kept"]:
            if low == high:
                return [low for _ in ranks]
            if counts["kept"] == size and slack >= 1:
                raise RuntimeError("the quantile sketch does not narrow the candidates down")
            values = values.where(F.col("v").between(low, high))
            below, size, slack = start, counts["kept"], 2.0 / SKETCH_ACCURACY
        else:
            slack *= 8
        shares = (min(ranks) - below) / size, (max(ranks) + 1 - below) / size
        seen = _sketch(values, *shares, slack)
    pairs = sorted(values.groupBy("v").agg(F.count("v").alias("n")).collect())
    found = {}
    for v, n in pairs:
        found.update({k: v for k in ranks if below <= k < below + n})
        below += n
    return [found[k] for k in ranks]


def exact_median(df: DataFrame, value: Column, *, limit: int = COLLECT_LIMIT) -> float | None:
    """Median, the mean of the two middle values for an even count."""
    middle = order_statistics(df, value, 0.5, lambda n: ((n - 1) // 2, n // 2), limit=limit)
    return None if middle is None else (middle[0] + middle[1]) / 2


def lowest_share(df: DataFrame, value: Column, share: float, *, limit: int = COLLECT_LIMIT):
    """Value of the last row among the lowest ``share`` of the rows, one row at least."""
    last = order_statistics(df, value, share, lambda n: (max(int(n * share), 1) - 1,), limit=limit)
    return None if last is None else last[0]


def order_statistic_of_groups(
    df: DataFrame, group: Column, value: Column, rank_of, *, limit: int = COLLECT_LIMIT
) -> dict:
    """For each of a few groups the value at the 0-based rank ``rank_of(rows of the group)``.

    All groups narrow down in the same passes: one sketches the values that are left around each
    group's rank, one counts what lies below and within. A group whose rank is below 0 has no value and is left
    out; so are null groups and values.
    """
    values = df.select(group.alias("g"), value.alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    sizes = values.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    groups = {r["g"]: {"rank": rank_of(r["n"]), "size": r["n"], "low": r["low"], "high": r["high"]} for r in sizes.collect()}
    groups = {g: s | {"below": 0, "slack": 2.0 / SKETCH_ACCURACY} for g, s in groups.items() if s["rank"] >= 0}

    def bound(name: str, states: dict) -> Column:
        out = F.lit(None)
        for g, s in states.items():
            out = F.when(F.col("g") == g, F.lit(s[name])).otherwise(out)
        return out

    def within(states: dict) -> Column:
        return F.col("v").between(bound("low", states), bound("high", states))

    while wide := {g: s for g, s in groups.items() if s["size"] > limit and s["low"] < s["high"]}:
        shares = []
        for s in wide.values():
            at = (s["rank"] - s["below"]) / s["size"], (s["rank"] + 1 - s["below"]) / s["size"]
            shares += [max(0.0, at[0] - s["slack"]), min(1.0, at[1] + s["slack"])]
        left = values.where(within(wide))
        around = left.groupBy("g").agg(F.percentile_approx("v", shares, SKETCH_ACCURACY).alias("around"))
        around = {r["g"]: r["around"] for r in around.collect()}
        tried = {g: {"low": around[g][2 * i], "high": around[g][2 * i + 1]} for i, g in enumerate(wide)}
        counts = values.groupBy("g").agg(
            F.count_if(F.col("v") < bound("low", tried)).alias("under"), F.count_if(within(tried)).alias("kept")
        )
        counts = {r["g"]: r for r in counts.collect()}
        for g, s in wide.items():
            under, kept = counts[g]["under"], counts[g]["kept"]
            if under <= s["rank"] < under + kept and (kept < s["size"] or tried[g]["low"] == tried[g]["high"]):
                s |= tried[g] | {"below": under, "size": kept, "slack": 2.0 / SKETCH_ACCURACY}
                groups[g] = s
            elif s["slack"] >= 1:
                raise RuntimeError("the quantile sketch does not narrow the candidates down")
            else:
                groups[g] = s | {"slack": s["slack"] * 8}
    found = {g: s["low"] for g, s in groups.items() if s["low"] == s["high"]}
    rest = {g: s for g, s in groups.items() if g not in found}
    if rest:
        pairs = values.where(within(rest)).groupBy("g", "v").agg(F.count("v").alias("n")).collect()
        for g, v, n in sorted(pairs):
            s = rest[g]
            if g not in found and s["below"] + n > s["rank"]:
                found[g] = v
            s["below"] += n
    return found
