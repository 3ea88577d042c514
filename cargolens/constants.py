"""Fixed values of the risk model.

Everything in this file is a value that results depend on: column names, limits, code lists,
label words, thresholds and message texts.  No logic lives here.
"""

# --- fixed values: declaration columns -------------------------------------------------
REQUIRED_COLUMNS = [
    "Container_ID",
    "Declaration_Date",
    "Declaration_Time",
    "Trade_Regime",
    "Origin_Country",
    "Destination_Country",
    "Destination_Port",
    "HS_Code",
    "Importer_ID",
    "Exporter_ID",
    "Declared_Value",
    "Declared_Weight",
    "Measured_Weight",
    "Shipping_Line",
    "Dwell_Time_Hours",
]
OPTIONAL_COLUMNS = ["Clearance_Status", "is_risky"]
MEASURES = ["Declared_Value", "Declared_Weight", "Measured_Weight", "Dwell_Time_Hours"]
CRITICAL_COLUMNS = ["Container_ID", "Declared_Value", "Declared_Weight", "Measured_Weight"]
COUNTRY_COLUMNS = ["Origin_Country", "Destination_Country"]
NUMERIC_NAME_PARTS = ["value", "weight", "dwell", "hours"]

# --- fixed values: inclusive limits of the range filter --------------------------------
RANGE_LIMITS = {
    "Declared_Value": (0.0, 1e8),
    "Declared_Weight": (0.1, 1000.0),
    "Measured_Weight": (0.1, 1000.0),
    "Dwell_Time_Hours": (0.0, 1000.0),
}

# --- fixed values: text tokens that a CSV reader takes as missing ----------------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
UNKNOWN = "UNKNOWN"

# --- fixed values: country and commodity risk classes ----------------------------------
HIGH_RISK_COUNTRIES = ["KP", "IR", "SY", "LY", "YE", "VE", "MM", "CU", "BY", "ZW", "HT", "SD"]
MEDIUM_RISK_COUNTRIES = ["NG", "PK", "AF", "SD", "IQ", "SO", "ML", "CD", "CF", "SS", "BA", "KE"]
HIGH_RISK_HS = ["27", "28", "39", "84", "85", "86"]
MEDIUM_RISK_HS = ["62", "63", "64", "65", "66", "67"]

# --- fixed values: country classes of the detail chart ---------------------------------
CHART_HIGH_RISK_COUNTRIES = ["KP", "IR", "SY", "LY", "YE", "VE", "MM", "CU", "BY"]
CHART_MEDIUM_RISK_COUNTRIES = ["NG", "PK", "AF", "SD", "IQ", "SO", "ML", "CD", "CF", "SS"]

# --- fixed values: label rules ----------------------------------------------------------
HISTORY_RISK_COUNTRIES = ["KP", "IR", "NG", "PK", "SY", "LB", "MY", "TH"]
HISTORY_RISK_STATUSES = ["Flagged", "Seized", "Rejected", "Held", "Under Review"]
SAMPLE_RISK_COUNTRIES = ["KP", "IR", "NG", "PK"]
POSITIVE_LABELS = [
    "1", "true", "yes", "y", "risk", "risky", "high", "high risk", "critical", "flagged", "seized",
    "rejected", "anomaly", "fraud",
]
NEGATIVE_LABELS = [
    "0", "false", "no", "n", "normal", "safe", "low", "low risk", "clear", "cleared",
]
POSITIVE_LABEL_PARTS = ["critical", "high", "risky"]
NEGATIVE_LABEL_PARTS = ["low", "clear", "safe"]

# --- fixed values: model features, in order ---------------------------------------------
FEATURES = [
    "weight_diff", "weight_diff_abs", "weight_diff_pct", "weight_ratio", "log_weight",
    "flag_weight_mismatch", "flag_zero_declared_weight",
    "value_per_kg", "log_value", "value_to_weight_ratio",
    "flag_high_value_density", "flag_low_value_density", "flag_zero_declared_value",
    "origin_country_risk", "dest_country_risk", "route_risk_total",
    "route_frequency_log", "flag_high_risk_route",
    "hs_code_risk",
    "day_of_week", "month", "day_of_month", "is_weekend", "is_month_end",
    "hour_of_day", "is_night", "is_business_hours",
    "dwell_time_log", "flag_excessive_dwell", "flag_minimal_dwell",
    "Trade_Regime_encoded", "Shipping_Line_encoded",
]
ENCODED_CATEGORIES = ["Trade_Regime", "Shipping_Line"]
EPSILON = 1e-9

# --- fixed values: risk levels and blend ------------------------------------------------
LEVELS = ["Critical", "High", "Medium", "Low"]
FLAGGED_LEVELS = ["Critical", "High"]
CRITICAL_FROM, HIGH_FROM, MEDIUM_FROM = 0.75, 0.50, 0.25
CLASSIFIER_WEIGHT, ANOMALY_WEIGHT = 0.7, 0.3
ANOMALY_CUTOFF = 0.7

# --- fixed values: explanation texts ----------------------------------------------------
TEXT_WEIGHT = "Measured weight is %s%% %s than declared."
TEXT_VALUE_HIGH = "Exceptionally high value density ($%s/kg) - possible luxury or contraband goods."
TEXT_VALUE_LOW = "Suspiciously low value density ($%s/kg) - possible undervaluation or commodity fraud."
TEXT_ORIGIN_HIGH = "high-risk origin country"
TEXT_ORIGIN_MEDIUM = "medium-risk origin country"
TEXT_DEST_HIGH = "high-risk destination"
TEXT_RARE_ROUTE = "infrequent or unusual trade route"
TEXT_ROUTE = "Route factors: %s."
TEXT_DWELL_LONG = "Excessive port dwell time (%s hours) - may indicate customs hold or processing issues."
TEXT_DWELL_SHORT = "Unusually rapid clearance (%s hours) - warrants verification."
TEXT_NIGHT = "submitted during off-hours"
TEXT_WEEKEND = "weekend submission"
TEXT_TIMING = "Timing flags: %s (may indicate avoidance of oversight)."
TEXT_HS = "HS code %s** associated with controlled/restricted commodities."
TEXT_MINOR = "Minor risk indicators noted: %s."
TEXT_NORMAL = "All parameters within normal ranges. Risk score: %s. Standard processing."
TEXT_NO_EXPLANATION = "No explanation available."

# --- fixed values: messages and file formats --------------------------------------------
MISSING_FIELD = "Missing required field: %s"
EXPORT_COLUMNS = ["Container_ID", "Risk_Score", "Risk_Level", "Explanation"]
REPORT_COLUMNS = [
    "Container_ID", "Risk_Score", "Risk_Level", "Origin_Country", "Declared_Value",
    "Declared_Weight", "Measured_Weight", "Dwell_Time_Hours", "HS_Code", "Shipping_Line",
    "Explanation_Summary",
]
HISTORY_RENAMES = {
    "Declaration_Date (YYYY-MM-DD)": "Declaration_Date",
    "Trade_Regime (Import / Export / Transit)": "Trade_Regime",
    "Destination_Country": "Destination_Country",
    "Destination_Port": "Destination_Port",
}

# --- fixed values: what is cut from the lines of uploaded files --------------------------
LINE_ENDS = "^\ufeff|\r$"
EMPTY_FIELDS = r"(,\s*)+$"
