"""Constants and wording whose exact text is part of the results."""

# --- Fixed values: missing-value spellings in delimited files -----------------------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# --- Fixed values: limits ------------------------------------------------------------------
FREE_ANALYSIS_LIMIT = 2
MAX_UPLOAD_MB = 200
OUTLIER_MIN_VALUES = 8
IQR_FACTOR = 1.5
SUMMARY_COLUMN_LIMIT = 50
TEXT_PREVIEW_CHARS = 5000
IMAGE_PREVIEW_CHARS = 3000

# --- Fixed values: upload suffix -> mode ---------------------------------------------------
SUFFIX_MODES = {
    "csv": "structured", "xlsx": "structured", "xls": "structured",
    "txt": "text", "docx": "text", "pdf": "text", "zip": "text",
    "png": "image", "jpg": "image", "jpeg": "image", "webp": "image",
}

# --- Fixed values: features that need a premium plan ---------------------------------------
PREMIUM_FEATURES = {
    "ai_insights": True,
    "forecast": True,
    "saved_reports": True,
    "data_doctor_autofix": True,
    "shareable_reports": True,
}

# --- Fixed values: metric registry (key, label, description, format, required columns) -----
METRICS = [
    ("record_count", "Records", "Total rows in dataset", "integer", []),
    ("column_count", "Columns", "Total fields available", "integer", []),
    ("missing_value_rate", "Missing Rate", "Share of missing data", "percent", []),
    ("duplicate_rate", "Duplicate Rate", "Share of duplicate rows", "percent", []),
    ("revenue", "Revenue", "Total sales value", "currency", ["Sales"]),
    ("customers", "Customers", "Total customer count", "integer", ["Customers"]),
    ("returns", "Returns", "Total returns count", "integer", ["Returns"]),
]

# --- Fixed values: industry templates (label, aggregate, which numeric column) -------------
INDUSTRY_KPIS = {
    "Finance": [("Total Value", "sum", 0), ("Average Value", "avg", 0), ("Maximum Value", "max", 0)],
    "Marketing": [("Performance Total", "sum", 0), ("Average Performance", "avg", 0), ("Growth Signal", "sum", 1)],
    "Sales": [("Sales Signal", "sum", 0), ("Average Sale Signal", "avg", 0), ("Peak Value", "max", 0)],
    "Logistics": [("Volume Processed", "sum", 0), ("Operational Average", "avg", 0), ("Capacity Signal", "sum", 1)],
    "Healthcare": [("Activity Volume", "sum", 0), ("Average Measure", "avg", 0)],
}
INDUSTRIES = [
    "General Business", "Finance", "Marketing", "Sales", "Healthcare",
    "Logistics", "Education", "Retail", "Operations",
]

# --- Fixed values: sentences ---------------------------------------------------------------
NO_DATA = "No data loaded."
NO_DATASET = "No dataset loaded."
HEALTHY_NOTE = "Dataset looks structurally healthy for first-pass analysis."
READY = "This dataset is ready for executive reporting, forecasting, and AI analysis."
CLEANING_RECOMMENDED = "This dataset is usable, but cleaning is recommended before major business decisions."
NEEDS_CLEANING = "This dataset needs cleaning before it should drive important decisions."

INSIGHT_MISSING = "Dataset contains missing values that may affect accuracy."
INSIGHT_DUPLICATES = "Duplicate records detected. Consider cleaning before analysis."
INSIGHT_CLEAN = "Dataset is clean and ready for analysis."

FIX_NUMERIC_GAPS = "Fill missing numeric values with median or business-approved defaults."
FIX_TEXT_GAPS = "Fill missing text fields with explicit placeholders like 'Unknown' only when appropriate."
FIX_DUPLICATES = "Review duplicate rows before deletion to separate true duplicates from repeated business events."
FIX_OUTLIERS = "Inspect outliers to separate real signals from data entry errors."
FIX_CONSTANTS = "Review constant columns. They may be placeholders, IDs gone wrong, or fields with no analytical value."
NO_ISSUES = "No major structural issues detected."
FIX_NOTHING = "Proceed with analysis while validating business context."
NO_FIX_ACTIONS = "No major cleaning issues found. Dataset already looks clean."
CLEANING_EFFECT = "The cleaning steps improved dataset quality for analysis."

FINDINGS_HEADING = "AI Data Doctor Findings\n-----------------------\n"
FIXES_HEADING = "\n\nRecommended Fixes\n-----------------\n"

SCENARIO_UP = "This scenario shows a positive projected movement."
SCENARIO_DOWN = "This scenario shows a negative projected movement."
SCENARIO_FLAT = "This scenario shows no projected movement."

DECISION_REPORT = (
    "\nDecision Engine Report\n"
    "\n1. Immediate Priority\n"
    "Review dataset quality before making major decisions.\n"
    "\n2. Main Risk\n"
    "Missing values: {missing}\n"
    "Duplicate rows: {duplicates}\n"
    "\n3. Recommended Action\n"
    "Clean the dataset, review trends, and validate key business columns.\n"
    "\n4. Business Impact\n"
    "Better data quality improves forecasting, reporting, and decision confidence.\n"
)
NO_INSIGHTS = "No AI insights generated yet."
NO_FINDINGS = "No Data Doctor report generated yet."
NO_DECISION = "No Decision Engine report generated yet."

FORECAST_MODEL = "Forecast model: LinearRegression"
FORECAST_NO_DATA = "Not enough data"
FORECAST_EXPLANATION = "Linear trend forecast generated from the historical pattern in the selected metric."
NO_OCR_TEXT = "No OCR text available."
NO_SUMMARY = "No summary available."
COMPARE_HEADING = "Comparison Summary\n------------------\n"
COMPARE_COLUMNS = "\n\nShared Numeric Column Changes:\n"
COMPARE_NONE = "\n\nNo shared numeric columns found for comparison."
