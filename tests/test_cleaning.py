import random
import statistics

import pytest
from pyspark.sql import functions as F

from cargolens.operators import cleaning as C
from cargolens.operators.selection import exact_median, lowest_share
from cargolens.schema import SchemaError
from cargolens.constants import REQUIRED_COLUMNS

MEASURES = "Container_ID string, Declared_Value double, Declared_Weight double, Measured_Weight double, Dwell_Time_Hours double, seq int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], MEASURES)


# value, declared, measured, dwell per row, in file order; the other columns do not matter here
EDGE_CASES = [
    ("10000001", 450000.0, 120.0, 119.8, 40.0),
    ("10000002", 18000.0, 35.0, 35.1, 25.0),
    ("10000003", 920000.0, 8500.0, 8490.0, 30.0),
    ("10000004", 1200000.0, 9100.0, 9050.0, 20.0),
    ("10000005", 55000.0, 6.5, 6.4, 50.0),
    ("# note 1", None, None, None, None),
    ("10000006", 450000.0, 100.0, 300.0, 45.0),
    ("10000007", 999999999.0, 200.0, 200.0, 30.0),
    ("10000008", 1.0, 5000.0, 5000.0, 35.0),
    ("10000009", -5000.0, 100.0, 100.0, 20.0),
    ("10000010", 20000.0, 0.0, 0.0, 40.0),
    ("10000011", 350000.0, 1000.0, 1000.0, 999.0),
    ("10000012", 500000.0, 200.0, 200.0, 0.1),
    ("10000013", 120000.0, 1000.0, 1500.0, 33.0),
    ("10000014", 500000.0, 1000000.0, 1000000.0, 60.0),
    ("10000001", 750000.0, 9000.0, 8900.0, 28.0),
]


def test_edge_cases_and_accounting(spark):
    df = frame(spark, EDGE_CASES)
    kept = C.clean(df, ["seq"], strict=False)
    assert sorted(r[0][-2:] for r in kept.collect()) == ["01", "02", "05", "06", "11", "12"]
    medians = C.clean_medians(df, ["seq"])
    counts = C.row_accounting(df, ["seq"], medians).first()
    assert counts["rows_received"] == 16 and counts["rows_valid"] == 6 and counts["rows_failed"] == 10
    assert counts["duplicates_removed"] == 1
    assert counts["rows_with_missing_critical"] == 1 and counts["invalid_value_ranges"] == 8
    for unique in (True, False):
        reasons = C.reject_reasons(df, ["seq"], medians, unique_order=unique)
        found = {r[0]: r[1] for r in reasons.groupBy("reject_reason").agg(F.sum("copies")).collect()}
        assert found == {None: 6, "duplicate": 1, "missing_critical": 1, "invalid_range": 8}


def test_strict_needs_all_columns(spark):
    with pytest.raises(SchemaError):
        C.clean(frame(spark, EDGE_CASES), ["seq"])


def test_small_examples(spark):
    copies = frame(spark, [("a", 1.0, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0, 1.0), ("a", 2.0, 1.0, 1.0, 1.0)])
    kept = C.remove_duplicates(copies, ["seq"]).collect()
    assert len(kept) == 3 and {r["Declared_Value"] for r in kept} == {1.0}
    holes = frame(spark, [("a", 1000.0, 100.0, 105.0, 1.0), ("b", None, 200.0, 210.0, 1.0), ("c", 3000.0, None, None, 1.0)])
    assert C.drop_missing_critical(holes).count() == 1
    wild = frame(spark, [("a", -1000.0, 100.0, 100.0, 1.0), ("b", 5000.0, 0.05, 100.0, 1.0), ("c", 1e9, 2000.0, 100.0, 1.0)])
    assert C.filter_ranges(wild).count() == 0
    assert C.filter_ranges(wild, {"Declared_Value": (None, 1e10)}).count() == 3


def test_nan_and_text_are_missing(spark):
    df = spark.createDataFrame(
        [("1", "NaN", "x", "2020-01-05 10:00:00"), ("2", "5", "1e2", "05.01.2020")],
        "Container_ID string, Declared_Value string, Declared_Weight string, Declaration_Date string",
    )
    rows = C.standardize(df, ["dd.MM.yyyy"]).orderBy("Container_ID").collect()
    assert rows[0]["Declared_Value"] is None and rows[0]["Declared_Weight"] is None
    assert rows[1]["Declared_Weight"] == 100.0
    assert [str(r["Declaration_Date"]) for r in rows] == ["2020-01-05", "2020-01-05"]


def test_null_ids_are_one_group(spark):
    df = frame(spark, [(None, 1.0, 1.0, 1.0, 1.0), (None, 2.0, 1.0, 1.0, 1.0), ("a", 1.0, 1.0, 1.0, 1.0)])
    reasons = C.reject_reasons(df, ["seq"], {})
    found = sorted((r["reject_reason"] or "", r["copies"]) for r in reasons.collect())
    assert found == [("", 1), ("duplicate", 1), ("missing_critical", 1)]


def test_hot_key_and_exact_copies(spark):
    """A third of the rows share one id, and a third are copies of one row."""
    base = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "copy").otherwise(F.col("id").cast("string")).alias("Container_ID"),
        F.when(F.col("id") % 3 == 1, 7.0).otherwise(F.col("id").cast("double") + 1).alias("Declared_Value"),
        F.lit(10.0).alias("Declared_Weight"), F.lit(10.0).alias("Measured_Weight"), F.lit(5.0).alias("Dwell_Time_Hours"),
    )
    kept = C.remove_duplicates(base, ["Declared_Value"])
    assert kept.count() == 10_002
    assert {r["Container_ID"]: r["Declared_Value"] for r in kept.where("Container_ID IN ('hot', 'copy')").collect()} == {"hot": 1.0, "copy": 7.0}
    reasons = C.reject_reasons(base, ["Declared_Value"], {})
    total = {r[0]: r[1] for r in reasons.groupBy("reject_reason").agg(F.sum("copies")).collect()}
    assert total == {None: 10_002, "duplicate": 19_998}
    assert reasons.where("Container_ID = 'copy'").count() == 2  # kept once, 9,999 copies in one row


def test_dedup_cuts_keys_before_the_shuffle(spark):
    df = frame(spark, EDGE_CASES)
    plan = C.remove_duplicates(df, ["seq"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan.split("Exchange hashpartitioning(Container_ID")[1]
    assert "WindowGroupLimit" in before_shuffle


@pytest.mark.parametrize("limit", [100_000, 50])
@pytest.mark.parametrize("size", [1, 2, 5_001, 6_000])
def test_exact_median(spark, limit, size):
    draw = random.Random(size)
    values = [draw.choice([draw.uniform(0, 1e9), 5.0, draw.gauss(0, 1)]) for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert exact_median(df, F.col("v"), limit=limit) == statistics.median(values)


def test_exact_median_of_nothing(spark):
    assert exact_median(spark.createDataFrame([(None,)], "v double"), F.col("v")) is None


def test_lowest_share(spark):
    df = spark.range(1000).select(F.xxhash64("id").alias("v"))
    values = sorted(r[0] for r in df.collect())
    for limit in (100_000, 20):
        assert lowest_share(df, F.col("v"), 0.1, limit=limit) == values[99]


def test_median_fill_and_unknown(spark):
    rows = [("a", 1.0, 1.0, 1.0, None), ("b", 1.0, 1.0, 1.0, 10.0), ("c", 1.0, 1.0, 1.0, 20.0), (None, 1.0, 1.0, 1.0, 900.0)]
    df = frame(spark, rows).withColumn("Origin_Country", F.lit(None).cast("string"))
    out = C.clean(df, ["seq"], strict=False)
    assert {r["Container_ID"]: r["Dwell_Time_Hours"] for r in out.collect()} == {"a": 15.0, "b": 10.0, "c": 20.0}
    assert {r["Origin_Country"] for r in out.collect()} == {"UNKNOWN"}
    again = C.clean(out, ["seq"], strict=False)
    assert sorted(again.collect()) == sorted(out.collect())


def test_preview(spark):
    df = spark.createDataFrame(
        [("US", "10", "x"), ("US", "", "4"), ("", "20", "8"), (None, None, None)],
        "Origin_Country string, Declared_Value string, Dwell_Time_Hours string",
    )
    row = C.preview(df).first()
    assert (row["total"], row["unique_origins"], row["avg_value"], row["avg_dwell"]) == (4, 1, 7.5, 3.0)


def test_required_columns_are_fifteen():
    assert len(REQUIRED_COLUMNS) == 15


def test_a_batch_reads_its_input_once(spark, tmp_path):
    """All tables of J3 come from one pass over the input, with the counters of separate passes."""
    from cargolens.functions.columns import col
    from cargolens.plans import jobs
    from cargolens.plans.testtables import ORDER, rule_columns, shipments
    from cargolens.sources.store import BatchStore

    raw = shipments(spark, "/root/testdata/sf0.001").withColumn("ingest_surplus", F.when(col("k_part") % 50 == 0, "x"))
    raw = raw.unionByName(raw.where("k_part % 7 = 0"))
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    counted = raw.mapInPandas(count, raw.schema)
    total = raw.count()
    store = BatchStore(spark, str(tmp_path))
    batch = jobs.score_table(counted, ORDER, rule_columns, store)
    assert seen.value == total
    rows = C.standardize(raw)
    medians = C.clean_medians(rows, ORDER)
    assert store.accounting(batch).first() == C.row_accounting(rows, ORDER, medians).first()
    names = ["Container_ID", "reject_reason", "copies"]
    alone = C.reject_reasons(rows, ORDER, medians).where("reject_reason IS NOT NULL").select(names)
    assert sorted(store.rejects(batch).select(names).collect(), key=str) == sorted(alone.collect(), key=str)
    cleaned = C.clean(raw, ORDER)
    assert sorted(store.cleaned(batch).select(cleaned.columns).collect(), key=str) == sorted(cleaned.collect(), key=str)
