"""SQL that DuckDB runs on the same tables, to check the registered queries.

The named steps below follow the definition of each stage in plain SQL. A query's text is the
steps it needs and one SELECT.
"""

from __future__ import annotations

from cargolens import constants as K
from cargolens.plans.testtables import ORDER, RULE_ANOMALY_SQL, RULE_CLASSIFIER_SQL, SHIPMENTS_SQL


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _class(expr: str, high: list[str], medium: list[str]) -> str:
    return f"CASE WHEN {expr} IN {_list(high)} THEN 2 WHEN {expr} IN {_list(medium)} THEN 1 ELSE 0 END"


def _joined(parts: list[str], sep: str) -> str:
    return f"array_to_string([x FOR x IN [{', '.join(parts)}] IF x IS NOT NULL], '{sep}')"


_country = (K.HIGH_RISK_COUNTRIES, K.MEDIUM_RISK_COUNTRIES)
_route_parts = [
    f"CASE origin_country_risk WHEN 2 THEN '{K.TEXT_ORIGIN_HIGH}' WHEN 1 THEN '{K.TEXT_ORIGIN_MEDIUM}' END",
    f"CASE WHEN dest_country_risk = 2 THEN '{K.TEXT_DEST_HIGH}' END",
    f"CASE WHEN route_frequency < 3 THEN '{K.TEXT_RARE_ROUTE}' END",
]
_timing_parts = [
    f"CASE WHEN is_night = 1 THEN '{K.TEXT_NIGHT}' END",
    f"CASE WHEN is_weekend = 1 THEN '{K.TEXT_WEEKEND}' END",
]


def _text(template: str, *parts: str) -> str:
    pieces = template.replace("%%", "%").split("%s")
    out = [f"'{pieces[0]}'"]
    for part, tail in zip(parts, pieces[1:]):
        out += [part, f"'{tail}'"]
    return " || ".join(out)


TEXTS = {
    "weight_text": "CASE WHEN abs(weight_diff_pct) > 20 THEN "
    + _text(
        K.TEXT_WEIGHT,
        "format('{:.1f}', abs(weight_diff_pct))",
        "CASE WHEN weight_diff_pct > 0 THEN 'higher' ELSE 'lower' END",
    )
    + " END",
    "value_text": "CASE WHEN flag_high_value_density = 1 THEN "
    + _text(K.TEXT_VALUE_HIGH, "format('{:,}', CAST(round_even(value_per_kg, 0) AS BIGINT))")
    + " WHEN flag_low_value_density = 1 THEN "
    + _text(K.TEXT_VALUE_LOW, "format('{:.2f}', value_per_kg)")
    + " END",
    "route_text": f"CASE WHEN {_joined(_route_parts, ', ')} <> '' THEN "
    + _text(K.TEXT_ROUTE, _joined(_route_parts, ", "))
    + " END",
    "dwell_text": "CASE WHEN flag_excessive_dwell = 1 THEN "
    + _text(K.TEXT_DWELL_LONG, "format('{:.0f}', Dwell_Time_Hours)")
    + " WHEN flag_minimal_dwell = 1 THEN "
    + _text(K.TEXT_DWELL_SHORT, "format('{:.0f}', Dwell_Time_Hours)")
    + " END",
    "timing_text": f"CASE WHEN {_joined(_timing_parts, ', ')} <> '' THEN "
    + _text(K.TEXT_TIMING, _joined(_timing_parts, ", "))
    + " END",
    "hs_text": f"CASE WHEN substr(HS_Code, 1, 2) IN {_list(K.HIGH_RISK_HS)} THEN "
    + _text(K.TEXT_HS, "substr(HS_Code, 1, 2)")
    + " END",
}

_critical = " AND ".join(f"{c} IS NOT NULL" for c in K.CRITICAL_COLUMNS)
_ranges = " AND ".join(f"{c} BETWEEN {lo!r} AND {hi!r}" for c, (lo, hi) in K.RANGE_LIMITS.items())
_order = ", ".join(f"{c} ASC NULLS FIRST" for c in ORDER)

STEPS = {
    "ships": SHIPMENTS_SQL,
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY Container_ID ORDER BY {_order}) AS rn FROM ships",
    "uniq": "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1",
    "complete": f"SELECT * FROM uniq WHERE {_critical}",
    "med": "SELECT median(Dwell_Time_Hours) AS m FROM complete",
    "filled": f"""SELECT * REPLACE (
        coalesce(Dwell_Time_Hours, (SELECT m FROM med)) AS Dwell_Time_Hours,
        coalesce(Origin_Country, '{K.UNKNOWN}') AS Origin_Country,
        coalesce(Clearance_Status, '{K.UNKNOWN}') AS Clearance_Status) FROM complete""",
    "cleaned": f"SELECT * FROM filled WHERE {_ranges}",
    "measured": """SELECT *, Measured_Weight - Declared_Weight AS weight_diff,
        abs(Measured_Weight - Declared_Weight) AS weight_diff_abs,
        (Measured_Weight - Declared_Weight) / (Declared_Weight + 1e-9) * 100 AS weight_diff_pct,
        Measured_Weight / (Declared_Weight + 1e-9) AS weight_ratio,
        ln(1 + Declared_Weight) AS log_weight,
        Declared_Value / (Declared_Weight + 1e-9) AS value_per_kg,
        Declared_Value / (Declared_Weight + 1e-9) AS value_to_weight_ratio,
        ln(1 + Declared_Value) AS log_value,
        ln(1 + Dwell_Time_Hours) AS dwell_time_log FROM cleaned""",
    "moments": """SELECT avg(weight_diff_abs) AS weight_mean, stddev_samp(weight_diff_abs) AS weight_std,
        avg(value_per_kg) AS density_mean, stddev_samp(value_per_kg) AS density_std,
        avg(Dwell_Time_Hours) AS dwell_mean, stddev_samp(Dwell_Time_Hours) AS dwell_std FROM measured""",
    "routes": "SELECT Origin_Country, Destination_Port, count(*) AS route_rows FROM measured GROUP BY 1, 2",
    "regimes": "SELECT Trade_Regime, count(*) AS n FROM measured GROUP BY 1",
    "lines": "SELECT Shipping_Line, count(*) AS n FROM measured GROUP BY 1",
    "feats": f"""SELECT m.*,
        CAST(weight_diff_abs > weight_mean + 2 * (weight_std + 1e-9) AS INT) AS flag_weight_mismatch,
        CAST(Declared_Weight <= 0 AS INT) AS flag_zero_declared_weight,
        CAST(value_per_kg > density_mean + 2 * (density_std + 1e-9) AS INT) AS flag_high_value_density,
        CAST(value_per_kg < density_mean - 1.5 * (density_std + 1e-9) AND value_per_kg > 0 AS INT)
          AS flag_low_value_density,
        CAST(Declared_Value <= 0 AS INT) AS flag_zero_declared_value,
        {_class('upper(m.Origin_Country)', *_country)} AS origin_country_risk,
        {_class('upper(m.Destination_Country)', *_country)} AS dest_country_risk,
        {_class('upper(m.Origin_Country)', *_country)} + {_class('upper(m.Destination_Country)', *_country)}
          AS route_risk_total,
        CAST({_class('upper(m.Origin_Country)', *_country)}
          + {_class('upper(m.Destination_Country)', *_country)} >= 3 AS INT) AS flag_high_risk_route,
        r.route_rows AS route_frequency, ln(1 + r.route_rows) AS route_frequency_log,
        {_class('substr(HS_Code, 1, 2)', K.HIGH_RISK_HS, K.MEDIUM_RISK_HS)} AS hs_code_risk,
        substr(HS_Code, 1, 1) AS hs_code_first_digit,
        isodow(Declaration_Date) - 1 AS day_of_week, month(Declaration_Date) AS month,
        day(Declaration_Date) AS day_of_month,
        CAST(isodow(Declaration_Date) >= 6 AS INT) AS is_weekend,
        CAST(day(Declaration_Date) >= 25 AS INT) AS is_month_end,
        CAST(substr(Declaration_Time, 1, 2) AS INT) AS hour_of_day,
        CAST(CAST(substr(Declaration_Time, 1, 2) AS INT) < 6
          OR CAST(substr(Declaration_Time, 1, 2) AS INT) >= 22 AS INT) AS is_night,
        CAST(CAST(substr(Declaration_Time, 1, 2) AS INT) BETWEEN 9 AND 17 AS INT) AS is_business_hours,
        CAST(Dwell_Time_Hours > dwell_mean + 1.5 * (dwell_std + 1e-9) AS INT) AS flag_excessive_dwell,
        CAST(Dwell_Time_Hours < 2 AS INT) AS flag_minimal_dwell,
        g.n AS Trade_Regime_encoded, s.n AS Shipping_Line_encoded
      FROM measured m CROSS JOIN moments
      JOIN routes r ON r.Origin_Country = m.Origin_Country AND r.Destination_Port = m.Destination_Port
      JOIN regimes g ON g.Trade_Regime = m.Trade_Regime
      JOIN lines s ON s.Shipping_Line = m.Shipping_Line""",
    "rules": f"SELECT *, {RULE_CLASSIFIER_SQL} AS classifier_score, {RULE_ANOMALY_SQL} AS anomaly_score FROM feats",
    "blended": """SELECT *, greatest(0e0, least(1e0, 0.7e0 * classifier_score + 0.3e0 * anomaly_score)) AS score
      FROM rules""",
    "levelled": """SELECT *, CASE WHEN score >= 0.75 THEN 'Critical' WHEN score >= 0.5 THEN 'High'
      WHEN score >= 0.25 THEN 'Medium' ELSE 'Low' END AS risk_level FROM blended""",
    "texts": "SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in TEXTS.items()) + " FROM levelled",
    "listed": "SELECT *, [x FOR x IN [" + ", ".join(TEXTS) + "] IF x IS NOT NULL] AS found FROM texts",
    "explained": f"""SELECT *, CASE
        WHEN len(found) = 0 THEN {_text(K.TEXT_NORMAL, "format('{:.2f}', score)")}
        WHEN risk_level = 'Critical' THEN array_to_string(found[1:2], ' ')
        WHEN risk_level IN ('High', 'Medium') THEN found[1]
        ELSE {_text(K.TEXT_MINOR, "array_to_string(found[1:2], '; ')")} END AS explanation_summary
      FROM listed""",
    "scored": """SELECT Container_ID AS id, score * 100 AS score, risk_level AS level,
        Origin_Country AS origin, Destination_Port AS port, Declared_Value AS value,
        Declared_Weight AS dw, Measured_Weight AS mw, Dwell_Time_Hours AS dwell, HS_Code AS hs,
        Shipping_Line AS line, explanation_summary AS expl, CAST(Declaration_Date AS VARCHAR) AS date,
        greatest(classifier_score, anomaly_score) AS confidence, classifier_score, anomaly_score
      FROM explained""",
    "spine": "SELECT * FROM (VALUES ('Critical', 0), ('High', 1), ('Medium', 2), ('Low', 3)) t(level, level_order)",
    "judged": """SELECT *, CAST(flag_weight_mismatch = 1 OR flag_high_value_density = 1
        OR origin_country_risk > 1 AS INT) AS label,
        CAST(score >= 0.5 AS INT) AS prediction FROM levelled""",
}
_before = list(STEPS)


def sql(last: str, select: str, *more: tuple[str, str]) -> str:
    """All steps up to ``last``, any further named steps, then the SELECT."""
    names = _before[: _before.index(last) + 1]
    steps = [(n, STEPS[n]) for n in names] + list(more)
    text = ",\n".join(f"{n} AS ({body})" for n, body in steps)
    return f"WITH {text}\n{select}"
