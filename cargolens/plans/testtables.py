"""The declaration table that queries and tests derive from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.functions.columns import col
from cargolens.operators.scoring import score_rows

TABLES = ["lineitem", "orders", "customer", "supplier", "part"]
ORDER = ["k_ship", "k_part", "k_supp", "k_price", "k_qty", "k_tax", "k_disc", "k_rf", "k_ls"]

# --- fixed values: country code per nation key ------------------------------------------
NATION_CODES = (
    "(0,'US'),(1,'CN'),(2,'IN'),(3,'BR'),(4,'DE'),(5,'JP'),(6,'GB'),(7,'FR'),(8,'KP'),(9,'IR'),"
    "(10,'NG'),(11,'PK'),(12,'BE'),(13,'VN'),(14,'CA'),(15,'SD'),(16,'AU'),(17,'SG'),(18,'NL'),"
    "(19,'CH'),(20,'SY'),(21,'KE'),(22,'IT'),(23,'ID'),(24,'th')"
)

SHIPMENTS_SQL = f"""
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS Container_ID,
  CAST(o_orderdate AS DATE) AS Declaration_Date,
  lpad(CAST(l_orderkey % 24 AS STRING), 2, '0') || ':'
    || lpad(CAST(l_partkey % 60 AS STRING), 2, '0') AS Declaration_Time,
  CASE l_returnflag WHEN 'A' THEN 'Import' WHEN 'N' THEN 'Export' ELSE 'Transit' END AS Trade_Regime,
  CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE so.code END AS Origin_Country,
  cd.code AS Destination_Country,
  'PORT_' || CAST(10 + l_suppkey % 5 * 10 AS STRING) AS Destination_Port,
  lpad(CAST((l_partkey * 7919) % 1000000 AS STRING), 6, '0') AS HS_Code,
  'IMP' || CAST(o_custkey AS STRING) AS Importer_ID,
  'EXP' || CAST(l_suppkey AS STRING) AS Exporter_ID,
  l_extendedprice AS Declared_Value,
  l_quantity * p_size AS Declared_Weight,
  CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN NULL
       WHEN l_partkey % 53 = 0 THEN l_quantity * p_size * 1.6
       ELSE l_quantity * p_size * (1 + l_tax - l_discount) END AS Measured_Weight,
  p_brand AS Shipping_Line,
  CASE WHEN l_quantity = 13 THEN NULL WHEN l_partkey % 97 = 0 THEN 400.0
       WHEN l_partkey % 89 = 0 THEN 0.5
       ELSE CAST(l_linenumber * 12 + l_suppkey % 7 AS DOUBLE) END AS Dwell_Time_Hours,
  CASE o_orderstatus WHEN 'F' THEN 'Cleared' WHEN 'O' THEN 'Flagged' ELSE NULL END
    AS Clearance_Status,
  l_shipdate AS k_ship, l_partkey AS k_part, l_suppkey AS k_supp, l_extendedprice AS k_price,
  l_quantity AS k_qty, l_tax AS k_tax, l_discount AS k_disc, l_returnflag AS k_rf,
  l_linestatus AS k_ls
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey
JOIN (VALUES {NATION_CODES}) AS so(k, code) ON s_nationkey = so.k
JOIN (VALUES {NATION_CODES}) AS cd(k, code) ON c_nationkey = cd.k
"""

# The same joins for Spark: orders meet their customers before they meet the many more line items, so where customers
# are too many to broadcast it is the orders that move, and line items move once for parts and once for orders. Line items
# need no order for that: where Spark would sort them, the other side is hashed instead, which leaves a task's memory to
# the sort of the wide rows that follows.
_JOINS = f"""FROM {{lineitem}}
JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN (VALUES {NATION_CODES}) AS so(k, code) ON s_nationkey = so.k
JOIN {{part}} AS part ON l_partkey = p_partkey
JOIN (
  SELECT o_orderkey, o_orderdate, o_custkey, o_orderstatus, n.code FROM {{orders}}
  JOIN {{customer}} ON o_custkey = c_custkey
  JOIN (VALUES {NATION_CODES}) AS n(k, code) ON c_nationkey = n.k
) AS cd ON l_orderkey = o_orderkey
"""

# Scores by rule, so that SQL can check everything behind them; the same text runs in both engines.
RULE_CLASSIFIER_SQL = (
    "least(1.0e0, 0.1e0 + 0.35e0 * flag_weight_mismatch + 0.3e0 * flag_high_value_density"
    " + 0.2e0 * origin_country_risk + 0.1e0 * dest_country_risk + 0.25e0 * flag_excessive_dwell"
    " + 0.1e0 * hs_code_risk + 0.15e0 * is_night)"
)
RULE_ANOMALY_SQL = (
    "least(1.0e0, abs(weight_diff_pct) / 80.0e0 + Dwell_Time_Hours / 500.0e0"
    " + value_per_kg / 20000.0e0)"
)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with duplicates, gaps and out-of-range weights, over the whole tables."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    columns = SHIPMENTS_SQL.partition("FROM lineitem\n")[0]
    plan = spark.sql("EXPLAIN " + columns + _JOINS, **tables).first()[0]
    hashed = [side for side, key in (("part", "l_partkey"), ("cd", "l_orderkey")) if f"SortMergeJoin [{key}#" in plan]
    hint = f"SELECT /*+ SHUFFLE_HASH({', '.join(hashed)}) */" if hashed else "SELECT"
    return spark.sql(columns.replace("SELECT", hint, 1) + _JOINS, **tables)


def rule_columns(df: DataFrame) -> DataFrame:
    """Feature rows with rule-made classifier and anomaly scores."""
    return df.withColumns(
        {
            "classifier_score": F.expr(RULE_CLASSIFIER_SQL),
            "anomaly_score": F.expr(RULE_ANOMALY_SQL),
        }
    )


def rule_scores(df: DataFrame) -> DataFrame:
    """The same, blended and levelled."""
    return score_rows(rule_columns(df)).withColumn("risk_score", col("score") * 100)
