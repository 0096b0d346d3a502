"""Schemas, vocabularies, rule texts and metric definitions.

Everything here is part of the data contract. Downstream readers compare these
names, versions and texts literally, so they are stated plainly and in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

RAW_SCHEMA_VERSION = "aes-public-csv-v1"
SILVER_SCHEMA_VERSION = "aes-silver-v1"
GOLD_SCHEMA_VERSION = "aes-gold-metrics-v1"
GOLD_LOGIC_VERSION = "aes-gold-rules-v3"
REVISION_VERSION = "aes-revision-v1"

VALUE_TYPE = "decimal(38,18)"

# ---------------------------------------------------------------------------
# Raw CSV and Bronze
# ---------------------------------------------------------------------------

RAW_COLUMNS = (
    "Year",
    "Industry_aggregation_NZSIOC",
    "Industry_code_NZSIOC",
    "Industry_name_NZSIOC",
    "Units",
    "Variable_code",
    "Variable_name",
    "Variable_category",
    "Value",
    "Industry_code_ANZSIC06",
)

OBSERVATION_KEY = (
    "Year",
    "Industry_aggregation_NZSIOC",
    "Industry_code_NZSIOC",
    "Variable_code",
)

# What may change on a republished observation besides its value.
REVISION_METADATA_COLUMNS = (
    "Industry_name_NZSIOC",
    "Units",
    "Variable_name",
    "Variable_category",
    "Industry_code_ANZSIC06",
)

METADATA_TYPES = {
    "ingestion_id": "string",
    "source_file": "string",
    "source_url": "string",
    "source_sha256": "string",
    "dataset_year": "int",
    "dataset_version": "string",
    "ingestion_timestamp": "timestamp",
    "row_count": "bigint",
    "schema_version": "string",
}

BRONZE_TYPES = {
    **{name: "string" for name in RAW_COLUMNS},
    **METADATA_TYPES,
    "source_row_number": "bigint",
}

# ---------------------------------------------------------------------------
# Silver
# ---------------------------------------------------------------------------

SILVER_TYPES = {
    "record_id": "string",
    "year": "int",
    "year_raw": "string",
    "industry_aggregation_nzsioc": "string",
    "industry_code_nzsioc": "string",
    "industry_name_nzsioc": "string",
    "industry_code_anzsic06": "string",
    "variable_code": "string",
    "variable_name": "string",
    "variable_category": "string",
    "units": "string",
    "value_raw": "string",
    "value_numeric": VALUE_TYPE,
    "value_status": "string",
    "record_status": "string",
    "is_valid": "boolean",
    "validation_rule_ids": "array<string>",
    "validation_failure_reasons": "array<string>",
    "ingestion_id": "string",
    "source_file": "string",
    "source_url": "string",
    "source_sha256": "string",
    "dataset_year": "int",
    "dataset_version": "string",
    "ingestion_timestamp": "timestamp",
    "source_row_count": "bigint",
    "source_schema_version": "string",
    "source_row_number": "bigint",
    "silver_schema_version": "string",
    "silver_input_fingerprint": "string",
    "silver_processing_timestamp": "timestamp",
}

LEVELS = ("Level 1", "Level 3", "Level 4")

# Java's "$" also matches before a final line break, so patterns end in "\z".
NUMERIC_PATTERN = r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\z"
YEAR_PATTERN = r"^\d{4}\z"

# Rule id -> reason, in the order both arrays list them.
ROW_RULES = {
    "YEAR_REQUIRED": "Year is null or blank.",
    "YEAR_INVALID_FORMAT": "Year must be four numeric digits.",
    "INDUSTRY_AGGREGATION_REQUIRED": "Industry aggregation level is null or blank.",
    "INDUSTRY_AGGREGATION_UNEXPECTED": "Industry aggregation level is outside the Phase 0 contract.",
    "INDUSTRY_CODE_REQUIRED": "NZSIOC industry code is null or blank.",
    "INDUSTRY_NAME_REQUIRED": "NZSIOC industry name is null or blank.",
    "ANZSIC_MAPPING_REQUIRED": "ANZSIC06 mapping is null or blank.",
    "VARIABLE_CODE_REQUIRED": "Variable code is null or blank.",
    "VARIABLE_NAME_REQUIRED": "Variable name is null or blank.",
    "VARIABLE_CATEGORY_REQUIRED": "Variable category is null or blank.",
    "UNITS_REQUIRED": "Units are null or blank.",
    "VARIABLE_DEFINITION_UNEXPECTED": "Code, name, category, and units do not match a Phase 0 definition.",
    "VALUE_UNAVAILABLE": "Source Value is null, empty, or whitespace-only.",
    "VALUE_INVALID": "Source Value is neither numeric text nor C or S.",
    "OBSERVATION_DUPLICATE": "Observation identity is duplicated within an ingestion.",
    "LINEAGE_REQUIRED": "One or more required Bronze lineage fields are unavailable.",
    "LINEAGE_ID_MISMATCH": "Ingestion ID does not equal the source SHA-256.",
    "SOURCE_ROW_NUMBER_INVALID": "Source row number is outside the captured source row count.",
    "SOURCE_ROW_NUMBER_DUPLICATE": "Source row number is duplicated within an ingestion.",
    "SOURCE_ROW_COUNT_MISMATCH": "Stored ingestion rows do not match Bronze row_count metadata.",
}

PERFORMANCE = "Financial performance"
POSITION = "Financial position"
RATIOS = "Financial ratios"
MILLIONS = "Dollars (millions)"

# (code, name, category, units). H04, H06 and H18 have two labels each, so the
# whole tuple is the lookup key.
VARIABLE_DEFINITIONS = (
    ("H01", "Total income", PERFORMANCE, MILLIONS),
    ("H02", "Sales of goods not further processed", PERFORMANCE, MILLIONS),
    ("H03", "Sales of other goods and services", PERFORMANCE, MILLIONS),
    ("H04", "Sales of goods and services", PERFORMANCE, MILLIONS),
    ("H04", "Sales, government funding, grants and subsidies", PERFORMANCE, MILLIONS),
    ("H05", "Interest, dividends and donations", PERFORMANCE, MILLIONS),
    ("H06", "Government funding, grants and subsidies", PERFORMANCE, MILLIONS),
    ("H06", "Sales, government funding, grants and subsidies", PERFORMANCE, MILLIONS),
    ("H07", "Non-operating income", PERFORMANCE, MILLIONS),
    ("H08", "Total expenditure", PERFORMANCE, MILLIONS),
    ("H09", "Interest and donations", PERFORMANCE, MILLIONS),
    ("H10", "Indirect taxes", PERFORMANCE, MILLIONS),
    ("H11", "Depreciation", PERFORMANCE, MILLIONS),
    ("H12", "Salaries and wages paid", PERFORMANCE, MILLIONS),
    ("H13", "Redundancy and severance", PERFORMANCE, MILLIONS),
    ("H14", "Salaries and wages to self employed commission agents", PERFORMANCE, MILLIONS),
    ("H17", "Purchases of goods bought for resale", PERFORMANCE, MILLIONS),
    ("H18", "Other Purchases and operating expenses", PERFORMANCE, MILLIONS),
    ("H18", "Other purchases and operating expenses", PERFORMANCE, MILLIONS),
    ("H19", "Purchases and other operating expenses", PERFORMANCE, MILLIONS),
    ("H20", "Non-operating expenses", PERFORMANCE, MILLIONS),
    ("H21", "Opening stocks", PERFORMANCE, MILLIONS),
    ("H22", "Closing stocks", PERFORMANCE, MILLIONS),
    ("H23", "Surplus before income tax", PERFORMANCE, MILLIONS),
    ("H24", "Total assets", POSITION, MILLIONS),
    ("H25", "Current assets", POSITION, MILLIONS),
    ("H26", "Fixed tangible assets", POSITION, MILLIONS),
    ("H27", "Additions to fixed assets", POSITION, MILLIONS),
    ("H28", "Disposals of fixed assets", POSITION, MILLIONS),
    ("H29", "Other assets", POSITION, MILLIONS),
    ("H30", "Total equity and liabilities", POSITION, MILLIONS),
    ("H31", "Shareholders funds or owners equity", POSITION, MILLIONS),
    ("H32", "Current liabilities", POSITION, MILLIONS),
    ("H33", "Other liabilities", POSITION, MILLIONS),
    ("H34", "Total income per employee count", RATIOS, "Dollars"),
    ("H35", "Surplus per employee count", RATIOS, "Dollars"),
    ("H36", "Current ratio", RATIOS, "Percentage"),
    ("H37", "Quick ratio", RATIOS, "Percentage"),
    ("H38", "Margin on sales of goods for resale", RATIOS, "Percentage"),
    ("H39", "Return on equity", RATIOS, "Percentage"),
    ("H40", "Return on total assets", RATIOS, "Percentage"),
    ("H41", "Liabilities structure", RATIOS, "Percentage"),
)

# ---------------------------------------------------------------------------
# Gold
# ---------------------------------------------------------------------------

IDENTITY = ("year", "industry_aggregation_nzsioc", "industry_code_nzsioc")


@dataclass(frozen=True)
class Metric:
    """A published metric (M1-M3) together with its yearly change (M4-M6)."""

    direct_id: str
    variable_code: str
    name: str
    category: str
    source_units: str
    unit: str
    change_id: str
    change_name: str
    change_unit: str
    change_is_percent: bool


METRICS = (
    Metric(
        "M1", "H01", "Total income", PERFORMANCE, MILLIONS, "NZD millions",
        "M4", "Total income year-over-year growth", "Percent change", True,
    ),
    Metric(
        "M2", "H23", "Surplus before income tax", PERFORMANCE, MILLIONS, "NZD millions",
        "M5", "Surplus before income tax year-over-year change", "NZD millions change", False,
    ),
    Metric(
        "M3", "H40", "Return on total assets", RATIOS, "Percentage", "Percent",
        "M6", "Return on total assets year-over-year change", "Percentage points", False,
    ),
)
CHANGE_METRIC_IDS = tuple(metric.change_id for metric in METRICS)

GOLD_TYPES = {
    "metric_record_id": "string",
    "year": "int",
    "industry_aggregation_nzsioc": "string",
    "industry_code_nzsioc": "string",
    "industry_name_nzsioc": "string",
    "industry_code_anzsic06": "string",
    "metric_id": "string",
    "metric_name": "string",
    "metric_type": "string",
    "metric_value": VALUE_TYPE,
    "metric_unit": "string",
    "metric_status": "string",
    "source_variable_code": "string",
    "source_variable_name": "string",
    "source_variable_category": "string",
    "source_variable_units": "string",
    "current_input_status": "string",
    "current_input_value": VALUE_TYPE,
    "current_input_record_ids": "array<string>",
    "prior_input_status": "string",
    "prior_input_value": VALUE_TYPE,
    "prior_input_record_ids": "array<string>",
    "source_silver_record_ids": "array<string>",
    "source_ingestion_ids": "array<string>",
    "source_sha256s": "array<string>",
    "silver_input_fingerprints": "array<string>",
    "gold_schema_version": "string",
    "gold_input_fingerprint": "string",
    "gold_processing_timestamp": "timestamp",
}

# ---------------------------------------------------------------------------
# Rankings
# ---------------------------------------------------------------------------

RANKING_TYPES = ("top_increases", "top_decreases", "largest_movements")
RANKING_PARTITION = ("year", "metric_id", "industry_aggregation_nzsioc")

BENCHMARK_COLUMNS = (
    "ranking_type",
    "rank_position",
    "year",
    "industry_aggregation_nzsioc",
    "metric_id",
    "metric_name",
    "metric_unit",
    "metric_status",
    "industry_code_nzsioc",
    "industry_name_nzsioc",
    "metric_value",
    "absolute_metric_value",
    "metric_record_id",
    "source_silver_record_ids",
    "source_ingestion_ids",
    "source_sha256s",
    "silver_input_fingerprints",
    "gold_schema_version",
    "gold_input_fingerprint",
    "gold_processing_timestamp",
)
# What a ranking reads; a Gold frame may have more columns.
BENCHMARK_INPUT_TYPES = {
    name: GOLD_TYPES[name] for name in BENCHMARK_COLUMNS if name in GOLD_TYPES
}

# ---------------------------------------------------------------------------
# Quality report: rule id -> (dimension, severity, description)
# ---------------------------------------------------------------------------

QUALITY_RULES = {
    "DQ_SCHEMA_REQUIRED_COLUMNS": (
        "schema", "BLOCKING", "Every implemented Silver column is present."),
    "DQ_SCHEMA_UNEXPECTED_COLUMNS": (
        "schema", "BLOCKING", "No undocumented columns are present."),
    "DQ_SCHEMA_COLUMN_TYPES": (
        "schema", "BLOCKING", "Silver columns use the implemented logical data types."),
    "DQ_COMPLETENESS_REQUIRED_DIMENSIONS": (
        "completeness", "BLOCKING", "Required observation dimensions are populated."),
    "DQ_VALIDITY_YEAR": (
        "validity", "BLOCKING", "Year is a consistent four-digit value."),
    "DQ_VALIDITY_AGGREGATION_LEVEL": (
        "validity", "BLOCKING", "Aggregation level is supported by the source contract."),
    "DQ_VALIDITY_VARIABLE_DEFINITION": (
        "business_contract", "BLOCKING",
        "Variable code, name, category, and units match an approved definition."),
    "DQ_VALIDITY_VALUE_STATE": (
        "validity", "BLOCKING",
        "Raw, numeric, and status values agree with the Silver value contract."),
    "DQ_UNIQUENESS_RECORD_ID": (
        "uniqueness", "BLOCKING", "Record identifiers are unique."),
    "DQ_UNIQUENESS_OBSERVATION_GRAIN": (
        "uniqueness", "BLOCKING",
        "Observations are unique at the approved ingestion/year/level/industry/variable grain."),
    "DQ_CONTRACT_VALIDATION_OUTCOME": (
        "business_contract", "BLOCKING",
        "Silver validity flags and failure arrays are internally consistent."),
    "DQ_CONTRACT_INVALID_ROWS": (
        "business_contract", "BLOCKING",
        "Silver contains no rows rejected by its implemented validation contract."),
    "DQ_CONTRACT_LINEAGE": (
        "business_contract", "BLOCKING",
        "Required source and processing lineage is complete and consistent."),
    "DQ_INFO_CONFIDENTIAL_ROWS": (
        "informational", "INFORMATIONAL",
        "Count confidential source observations without treating them as failures."),
    "DQ_INFO_SUPPRESSED_ROWS": (
        "informational", "INFORMATIONAL",
        "Count suppressed source observations without treating them as failures."),
    "DQ_INFO_NEGATIVE_PUBLISHED_ROWS": (
        "informational", "INFORMATIONAL",
        "Count valid negative published values without treating them as failures."),
}

PRECEDENCE_RULE = (
    "For an overlapping observation, incoming dataset_year must be strictly "
    "greater than the selected release dataset_year; dataset_version strings, "
    "filenames, and SHA-256 values are not ordered."
)


def ddl(types: dict[str, str]) -> str:
    """Column types as the DDL text Spark's readers and ``from_*`` functions take."""
    return ", ".join(f"`{name}` {kind}" for name, kind in types.items())


def struct_type(types: dict[str, str]) -> StructType:
    return StructType.fromDDL(ddl(types))
