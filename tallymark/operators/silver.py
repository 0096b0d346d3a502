"""Silver: typed, classified and checked observations. No row is ever dropped."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import (
    BRONZE_TYPES,
    LEVELS,
    OBSERVATION_KEY,
    ROW_RULES,
    SILVER_SCHEMA_VERSION,
    SILVER_TYPES,
)
from tallymark.functions.skew import HOT_MIN_ROWS, attach_group_facts
from tallymark.functions.text import (
    any_of,
    is_blank,
    is_complete_definition,
    is_year_text,
    numeric_value,
    quoted,
    quoted_list,
    split_texts,
    texts_where,
    value_status,
    year_value,
)
from tallymark.operators.bronze import iso_instant
from tallymark.operators.current_view import select_current
from tallymark.operators.schema_check import ORDERED, check_schema
from tallymark.session import keep_methods_compiled, stage

LINEAGE_TEXT = (
    "ingestion_id",
    "source_file",
    "source_url",
    "source_sha256",
    "dataset_version",
    "schema_version",
)
_NUMBERED = ("ingestion_id", "source_row_number")
#: What is known of an artifact without reading it again.
FACT_TYPES = {
    "ingestion_id": "string",
    "source_sha256": "string",
    "artifact_rows": "bigint",
    "repeated_numbers": "boolean",
}
VALUE_STATUSES = ("PUBLISHED", "CONFIDENTIAL", "SUPPRESSED", "UNAVAILABLE", "INVALID")
# Up to here per-artifact counts are broadcast (one short row each), beyond joined by shuffle.
MANY_ARTIFACTS = 100_000
LINEAGE_TYPED = ("dataset_year", "ingestion_timestamp", "row_count", "source_row_number")


def artifact_facts(rows: DataFrame) -> DataFrame:
    """Rows per artifact and digest, and whether the artifact uses a row number twice.

    Numbers are compared as bits, 32,768 of them in one shuffled row.
    """
    digests = rows.groupBy("ingestion_id", "source_sha256").agg(F.count(F.lit(1)).alias("artifact_rows"))
    numbers = (
        rows.groupBy("ingestion_id", F.expr("bitmap_bucket_number(source_row_number) AS _bucket"))
        .agg(
            F.count("source_row_number").alias("_used"),
            F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(source_row_number))) AS _different"),
            F.expr("count_if(source_row_number IS NULL) AS _missing"),
        )
        .groupBy(F.col("ingestion_id").alias("_artifact"))
        .agg(F.expr("sum(_used) <> sum(if(_bucket IS NULL, 0, _different)) OR sum(_missing) > 1 AS repeated_numbers"))
    )
    return digests.join(numbers, F.col("ingestion_id").eqNullSafe(F.col("_artifact"))).select(*FACT_TYPES)


def to_silver(
    bronze: DataFrame,
    *,
    fingerprint: str,
    processed_at: datetime,
    many_artifacts: bool | None = None,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Type and check every Bronze row as it stands, without release selection."""
    check_schema(bronze, BRONZE_TYPES, ORDERED, "Bronze")
    keys = ("ingestion_id", *OBSERVATION_KEY)
    repeated = bronze.groupBy(*keys).agg(F.count(F.lit(1)).alias("observation_rows"))
    rows = attach_group_facts(
        bronze,
        repeated.where("observation_rows > 1"),
        keys,
        "observation_rows",
        null_safe=True,
        hot_min_rows=hot_min_rows,
    )
    return _checked(rows, bronze, fingerprint, processed_at, hot_min_rows, None, many_artifacts)


def build_silver(
    history: DataFrame,
    *,
    fingerprint: str,
    processed_at: datetime,
    facts: DataFrame | None = None,
    current: DataFrame | None = None,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Silver snapshot of the current view over the whole Bronze history.

    Completeness and row numbering are facts about an artifact, so they are measured
    over its full history: rows that a newer release did not replace stay valid.
    Where ``artifact_facts`` and ``current_releases`` of the history are stored, pass
    them: the history is then read once.
    """
    check_schema(history, BRONZE_TYPES, ORDERED, "Bronze")
    rows = select_current(history, with_counts=True, current=current, hot_min_rows=hot_min_rows)
    return _checked(rows, history, fingerprint, processed_at, hot_min_rows, facts)


def _checked(
    rows: DataFrame,
    history: DataFrame,
    fingerprint: str,
    processed_at: datetime,
    hot_min_rows: int,
    facts: DataFrame | None,
    many_artifacts: bool | None = None,
) -> DataFrame:
    keep_methods_compiled(history.sparkSession)
    facts = stage(artifact_facts(history), "artifact-facts") if facts is None else facts
    known = facts.agg(F.count("*").alias("artifacts"), F.expr("coalesce(bool_or(repeated_numbers), false) AS repeated")).first()
    if known["repeated"]:
        repeats = (
            history.groupBy(*_NUMBERED)
            .agg(F.count(F.lit(1)).alias("number_rows"))
            .where("number_rows > 1")
        )
        rows = attach_group_facts(
            rows, repeats, _NUMBERED, "number_rows", null_safe=True, hot_min_rows=hot_min_rows
        )
    else:
        # The rows are then shuffled once instead of twice.
        rows = rows.withColumn("number_rows", F.lit(1))
    artifact_rows = facts.groupBy("ingestion_id").agg(F.sum("artifact_rows").alias("artifact_rows"))
    if known["artifacts"] > MANY_ARTIFACTS if many_artifacts is None else many_artifacts:
        rows = attach_group_facts(
            rows, artifact_rows, ["ingestion_id"], "artifact_rows", null_safe=True,
            hot_min_rows=hot_min_rows,
        )
    else:
        counts = artifact_rows.withColumnRenamed("ingestion_id", "_artifact")
        rows = rows.join(
            F.broadcast(counts), F.col("ingestion_id").eqNullSafe(F.col("_artifact")), "left"
        )
    rules = row_rules()
    typed = rows.withColumn("_status", F.expr(value_status("Value"))).withColumn(
        "_failed", F.expr(texts_where((condition, rule) for rule, condition in rules.items()))
    )
    # Reasons follow the same conditions and are only evaluated for failing rows.
    reasons = texts_where((condition, ROW_RULES[rule]) for rule, condition in rules.items())
    sources = {
        "record_id": "concat_ws(':', ingestion_id, CAST(source_row_number AS STRING))",
        "year": year_value("Year"),
        "year_raw": "Year",
        "industry_aggregation_nzsioc": "Industry_aggregation_NZSIOC",
        "industry_code_nzsioc": "Industry_code_NZSIOC",
        "industry_name_nzsioc": "Industry_name_NZSIOC",
        "industry_code_anzsic06": "Industry_code_ANZSIC06",
        "variable_code": "Variable_code",
        "variable_name": "Variable_name",
        "variable_category": "Variable_category",
        "units": "Units",
        "value_raw": "Value",
        "value_numeric": f"CASE WHEN _status = 'PUBLISHED' THEN {numeric_value('Value')} END",
        "value_status": "_status",
        "record_status": "CASE WHEN _failed = '' THEN 'VALID' ELSE 'INVALID' END",
        "is_valid": "_failed = ''",
        "validation_rule_ids": split_texts("_failed"),
        "validation_failure_reasons": split_texts("_failed", reasons),
        "source_row_count": "row_count",
        "source_schema_version": "schema_version",
        "silver_schema_version": quoted(SILVER_SCHEMA_VERSION),
        "silver_input_fingerprint": quoted(fingerprint),
        "silver_processing_timestamp": f"TIMESTAMP {quoted(iso_instant(processed_at))}",
    }
    return typed.selectExpr(*[f"{sources.get(name, name)} AS {name}" for name in SILVER_TYPES])


def row_rules() -> dict[str, str]:
    """Rule id -> condition under which a row fails it.

    Needs the raw columns plus ``_status`` and the attached counts
    ``observation_rows``, ``number_rows`` and ``artifact_rows`` (null = 1).
    """
    definition = ("Variable_code", "Variable_name", "Variable_category", "Units")
    level = "Industry_aggregation_NZSIOC"
    conditions = {
        "YEAR_REQUIRED": is_blank("Year"),
        "YEAR_INVALID_FORMAT": f"NOT {is_blank('Year')} AND NOT {is_year_text('Year')}",
        "INDUSTRY_AGGREGATION_REQUIRED": is_blank(level),
        "INDUSTRY_AGGREGATION_UNEXPECTED": (
            f"NOT {is_blank(level)} AND {level} NOT IN ({quoted_list(LEVELS)})"
        ),
        "INDUSTRY_CODE_REQUIRED": is_blank("Industry_code_NZSIOC"),
        "INDUSTRY_NAME_REQUIRED": is_blank("Industry_name_NZSIOC"),
        "ANZSIC_MAPPING_REQUIRED": is_blank("Industry_code_ANZSIC06"),
        "VARIABLE_CODE_REQUIRED": is_blank("Variable_code"),
        "VARIABLE_NAME_REQUIRED": is_blank("Variable_name"),
        "VARIABLE_CATEGORY_REQUIRED": is_blank("Variable_category"),
        "UNITS_REQUIRED": is_blank("Units"),
        "VARIABLE_DEFINITION_UNEXPECTED": (
            f"NOT {any_of(map(is_blank, definition))} AND NOT {is_complete_definition(*definition)}"
        ),
        "VALUE_UNAVAILABLE": "_status = 'UNAVAILABLE'",
        "VALUE_INVALID": "_status = 'INVALID'",
        "OBSERVATION_DUPLICATE": "observation_rows > 1",
        "LINEAGE_REQUIRED": any_of(
            [*map(is_blank, LINEAGE_TEXT), *[f"{name} IS NULL" for name in LINEAGE_TYPED]]
        ),
        "LINEAGE_ID_MISMATCH": (
            f"NOT {is_blank('ingestion_id')} AND NOT {is_blank('source_sha256')} "
            "AND ingestion_id <> source_sha256"
        ),
        "SOURCE_ROW_NUMBER_INVALID": "source_row_number NOT BETWEEN 1 AND row_count",
        "SOURCE_ROW_NUMBER_DUPLICATE": "number_rows > 1",
        "SOURCE_ROW_COUNT_MISMATCH": "artifact_rows <> row_count",
    }
    if list(conditions) != list(ROW_RULES):
        raise ValueError("Row rules and their texts are out of step.")
    return conditions


def snapshot_counts() -> dict[str, Column]:
    """Counts of statuses, validity and failed rules, to be taken while Silver is written."""
    statuses = {f"status:{status}": F.count_if(F.col("value_status") == status) for status in VALUE_STATUSES}
    rules = {f"rule:{rule}": F.count_if(F.array_contains("validation_rule_ids", rule)) for rule in ROW_RULES}
    return {"valid": F.count_if("is_valid"), **statuses, **rules}


def failure_distribution(silver: DataFrame) -> DataFrame:
    """How many rows fail each rule."""
    return (
        silver.select(F.explode("validation_rule_ids").alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def status_counts(silver: DataFrame) -> DataFrame:
    return silver.groupBy("value_status").agg(F.count(F.lit(1)).alias("rows"))
