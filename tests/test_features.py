import datetime

import pytest
from pyspark.sql import functions as F

from cargolens.constants import FEATURES
from cargolens.operators.features import available_features, engineer_features, with_measures
from cargolens.operators.profile import Profile, fit_profile
from cargolens.schema import SHIPMENT_SCHEMA, SchemaError

ROWS = [
    ("C001", datetime.date(2023, 1, 2), "10:30", "FREE", "US", "CN", "PORT_A", "8471", "I1", "E1", 10000.0, 1000.0, 1200.0, "MSC", 24.0),
    ("C002", datetime.date(2023, 1, 8), "22:15", "BOND", "KP", "US", "PORT_B", "2710", "I2", "E2", 50000.0, 500.0, 510.0, "MAERSK", 100.0),
    ("C003", datetime.date(2023, 1, 9), "03:00", "FREE", "DE", "NG", "PORT_C", "6203", "I3", "E3", 5000.0, 100.0, 95.0, "MSC", 2.0),
]


@pytest.fixture(scope="module")
def shipments(spark):
    return spark.createDataFrame(ROWS, SHIPMENT_SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("Container_ID").select("Container_ID", name).collect()]


def test_worked_example(shipments):
    f = engineer_features(shipments).cache()
    assert column(f, "weight_diff") == [200.0, 10.0, -5.0]
    assert [round(v, 6) for v in column(f, "weight_diff_pct")] == [20.0, 2.0, -5.0]
    assert column(f, "flag_weight_mismatch") == [0, 0, 0]
    assert [round(v, 6) for v in column(f, "value_per_kg")] == [10.0, 100.0, 50.0]
    assert column(f, "origin_country_risk") == [0, 2, 0]
    assert column(f, "dest_country_risk") == [0, 0, 1]
    assert column(f, "route_risk_total") == [0, 2, 1]
    assert column(f, "route_frequency") == [1, 1, 1]
    assert column(f, "hs_code_risk") == [2, 2, 1]
    assert column(f, "hs_code_first_digit") == ["8", "2", "6"]
    assert column(f, "day_of_week") == [0, 6, 0] and column(f, "is_weekend") == [0, 1, 0]
    assert column(f, "hour_of_day") == [10, 22, 3]
    assert column(f, "is_night") == [0, 1, 1] and column(f, "is_business_hours") == [1, 0, 0]
    assert column(f, "flag_excessive_dwell") == [0, 0, 0] and column(f, "flag_minimal_dwell") == [0, 0, 0]
    assert column(f, "Trade_Regime_encoded") == [2, 1, 2] and column(f, "Shipping_Line_encoded") == [2, 1, 2]
    assert available_features(f) == FEATURES and len(FEATURES) == 32


def test_one_row_has_no_deviation(shipments):
    f = engineer_features(shipments.limit(1)).first()
    flags = ["flag_weight_mismatch", "flag_high_value_density", "flag_low_value_density", "flag_excessive_dwell"]
    assert [f[c] for c in flags] == [0, 0, 0, 0] and f["route_frequency"] == 1


def test_missing_values_and_columns(spark, shipments):
    odd = shipments.limit(1).select(
        *[F.lit(None).cast(shipments.schema[c].dataType).alias(c) for c in shipments.columns if c not in ("Declaration_Date", "Declaration_Time")]
    )
    row = engineer_features(odd).first()
    assert (row["Declared_Weight"], row["Measured_Weight"], row["Declared_Value"], row["Dwell_Time_Hours"]) == (1.0, 1.0, 0.0, 24.0)
    assert row["flag_zero_declared_value"] == 1 and row["route_frequency"] == 1
    assert (row["day_of_week"], row["month"], row["day_of_month"], row["hour_of_day"]) == (0, 1, 1, 12)
    assert row["Trade_Regime_encoded"] == 0 and row["origin_country_risk"] == 0
    with pytest.raises(SchemaError):
        engineer_features(shipments.drop("HS_Code"))


def test_bad_times_and_shared_country(shipments):
    df = shipments.withColumn("Declaration_Time", F.lit("9.5:00")).withColumn("Origin_Country", F.lit("sd"))
    f = engineer_features(df)
    assert column(f, "hour_of_day") == [12, 12, 12] and column(f, "origin_country_risk") == [2, 2, 2]


def test_low_density_and_zero_value(spark):
    rows = [(f"C{i:03}", *ROWS[0][1:10], 1000.0 if i else 1.0, 10.0, 10.0, "MSC", 24.0) for i in range(50)]
    f = engineer_features(spark.createDataFrame(rows, SHIPMENT_SCHEMA))
    assert [r[0] for r in f.where("flag_low_value_density = 1").select("Container_ID").collect()] == ["C000"]
    assert f.where("flag_zero_declared_value = 1").count() == 0
    assert f.agg(F.max("route_frequency")).first()[0] == 50


def test_frozen_profile_gives_batch_features(spark, shipments, tmp_path):
    fitted = fit_profile(with_measures(shipments))
    fitted.anomaly_bounds = (0.1, 0.9)
    fitted.medians = {"Dwell_Time_Hours": 24.0}
    fitted.save(str(tmp_path))
    loaded = Profile.load(spark, str(tmp_path))
    assert loaded.anomaly_bounds == (0.1, 0.9) and loaded.medians == fitted.medians
    batch, frozen = engineer_features(shipments), engineer_features(shipments, loaded)
    names = ["Container_ID", *FEATURES]
    assert sorted(batch.select(names).collect()) == sorted(frozen.select(names).collect())


def test_profile_counts_rows_once(shipments):
    """No row is multiplied for the lookups: they come from one table of counts."""
    profile = fit_profile(with_measures(shipments))
    routes = shipments.na.drop(subset=["Origin_Country", "Destination_Port"])
    expected = routes.groupBy("Origin_Country", "Destination_Port").count().collect()
    assert sorted(map(tuple, profile.routes.collect())) == sorted(map(tuple, expected))
    plan = engineer_features(shipments, profile)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_repartitioning_changes_nothing(shipments):
    a = engineer_features(shipments).select("Container_ID", *FEATURES)
    b = engineer_features(shipments.repartition(3)).select("Container_ID", *FEATURES)
    assert sorted(a.collect()) == sorted(b.collect())
