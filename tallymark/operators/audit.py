"""Invariant checks over stored tables; each returns counts that should be zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import IDENTITY, METADATA_TYPES, RANKING_PARTITION
from tallymark.functions.text import quoted
from tallymark.session import stage

GOLD_GRAIN = ("gold_input_fingerprint", *IDENTITY, "metric_id")


def _counts(frame: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """(check_name, rows) from one global aggregate."""
    wide = frame.agg(
        *[F.expr(f"count_if({condition}) AS {name}") for name, condition in conditions.items()]
    )
    pairs = ", ".join(f"struct({quoted(name)} AS a, {name} AS b)" for name in conditions)
    return wide.selectExpr(f"inline(array({pairs})) AS (check_name, rows)")


def _named(frame: DataFrame, name: str, count: str = "rows") -> DataFrame:
    return frame.selectExpr(
        f"{quoted(name)} AS check_name", f"CAST(coalesce({count}, 0) AS BIGINT) AS rows"
    )


def bronze_profile(bronze: DataFrame) -> DataFrame:
    """Rows, protected markers and distinct metadata records per artifact."""
    metadata = [name for name in METADATA_TYPES if name != "ingestion_id"]
    per_record = bronze.groupBy("ingestion_id", *metadata).agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr("count_if(Value = 'C') AS confidential"),
        F.expr("count_if(Value = 'S') AS suppressed"),
    )
    return per_record.groupBy("ingestion_id").agg(
        F.sum("rows").alias("rows"),
        F.sum("confidential").alias("confidential_markers"),
        F.sum("suppressed").alias("suppressed_markers"),
        F.count(F.lit(1)).alias("metadata_records"),
        F.expr("max(row_count) AS stated_rows"),
    )


def audit_silver(silver: DataFrame) -> DataFrame:
    return _counts(
        silver,
        {
            "published_with_null_numeric": "value_status = 'PUBLISHED' AND value_numeric IS NULL",
            "protected_with_numeric": (
                "value_status IN ('CONFIDENTIAL', 'SUPPRESSED') AND value_numeric IS NOT NULL"
            ),
            "negative_published_values": "value_status = 'PUBLISHED' AND value_numeric < 0",
            "confidential_raw_mismatches": "value_raw = 'C' AND value_status <> 'CONFIDENTIAL'",
            "suppressed_raw_mismatches": "value_raw = 'S' AND value_status <> 'SUPPRESSED'",
        },
    )


def lineage_audit(silver: DataFrame, bronze: DataFrame) -> DataFrame:
    """Silver rows with no Bronze row of the same artifact, row number and raw value.

    Silver rows are counted per lineage triple and Bronze triples made distinct first,
    so repeated row numbers neither multiply nor skew the join.
    """
    stored = bronze.select("ingestion_id", "source_row_number", "Value").distinct()
    missing = (
        silver.groupBy("ingestion_id", "source_row_number", "value_raw")
        .agg(F.count(F.lit(1)).alias("n"))
        .alias("s")
        .join(
            stored.alias("b"),
            F.expr(
                "s.ingestion_id = b.ingestion_id "
                "AND s.source_row_number = b.source_row_number AND s.value_raw <=> b.Value"
            ),
            "left_anti",
        )
        .agg(F.sum("n").alias("rows"))
    )
    return _named(missing, "lineage_or_raw_value_mismatches")


#: Rows of Gold that an audit counts, by check.
GOLD_LEAKS = {
    "protected_numeric_leaks": "metric_status IN ('CONFIDENTIAL', 'SUPPRESSED') AND metric_value IS NOT NULL",
    "unavailable_numeric_leaks": "metric_status <> 'PUBLISHED' AND metric_value IS NOT NULL",
    "missing_lineage_rows": (
        "size(silver_input_fingerprints) = 0 OR gold_input_fingerprint IS NULL OR gold_schema_version IS NULL"
    ),
}


def audit_gold(gold: DataFrame) -> DataFrame:
    """All checks from one pass, in which rows are counted by their grain."""
    per_grain = gold.groupBy(*GOLD_GRAIN).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"count_if({condition}) AS {name}") for name, condition in GOLD_LEAKS.items()],
    )
    sums = {**{name: name for name in GOLD_LEAKS}, "repeated_grain_rows": "n - 1"}
    wide = per_grain.agg(*[F.expr(f"coalesce(sum({count}), 0L) AS {name}") for name, count in sums.items()])
    pairs = ", ".join(f"struct({quoted(name)} AS a, {name} AS b)" for name in sums)
    return wide.selectExpr(f"inline(array({pairs})) AS (check_name, rows)")


def mixed_definitions(silver: DataFrame) -> DataFrame:
    """Industry-years whose rows disagree on name or mapping.

    All six metrics of such an industry-year lose their value, typically after a
    release renamed an industry for some variables only.
    """
    return (
        silver.groupBy(*IDENTITY, "industry_name_nzsioc", "industry_code_anzsic06")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy(*IDENTITY)
        .agg(F.count(F.lit(1)).alias("definitions"), F.sum("rows").alias("rows"))
        .where("definitions > 1")
    )


def acceptance_points(gold: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare single metrics with expected values.

    ``expected`` has the identity columns, ``metric_id``, ``expected_value`` (decimal
    text, null for none), ``decimals`` (null for exact) and ``expected_status``.
    """
    keys = [*IDENTITY, "metric_id"]
    value = "metric_value"
    return (
        expected.join(gold.select(*keys, value, "metric_status"), keys, "left")
        .selectExpr(
            *keys, "expected_value", "expected_status", value, "metric_status",
            """coalesce(metric_status = expected_status, false) AND CASE
                WHEN decimals IS NULL OR expected_value IS NULL
                    THEN metric_value <=> CAST(expected_value AS DECIMAL(38,18))
                ELSE coalesce(
                    abs(metric_value - CAST(expected_value AS DECIMAL(38,18)))
                        <= CAST(0.5 * power(10, -decimals) AS DECIMAL(38,18)), false)
                END AS verified""",
        )
        .orderBy(*keys)
    )


def audit_rankings(rankings: list[DataFrame], gold: DataFrame) -> DataFrame:
    """Invariants of ranking results: dense positions, sign, magnitude, published only."""
    columns = [
        "ranking_type", "rank_position", *RANKING_PARTITION, "metric_unit", "metric_value",
        "absolute_metric_value", "metric_record_id",
    ]
    # Read by three checks; a ranking would be made anew for each.
    ranked = stage(reduce(DataFrame.unionByName, [frame.select(*columns) for frame in rankings]), "ranked")
    per_row = _counts(
        ranked,
        {
            "missing_unit_or_value": "metric_unit IS NULL OR metric_value IS NULL",
            "wrong_magnitude": "abs(metric_value) <> absolute_metric_value",
            "wrong_sign": (
                "(ranking_type = 'top_increases' AND metric_value <= 0) "
                "OR (ranking_type = 'top_decreases' AND metric_value >= 0)"
            ),
        },
    )
    # Positions 1..n: smallest 1, largest n, and no repetition.
    gaps = (
        ranked.groupBy("ranking_type", *RANKING_PARTITION, "rank_position")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("ranking_type", *RANKING_PARTITION)
        .agg(
            F.expr(
                "max(n) > 1 OR min(rank_position) <> 1 OR max(rank_position) <> count(*) AS broken"
            )
        )
        .agg(F.expr("count_if(broken) AS rows"))
    )
    unpublished = (
        ranked.select("metric_record_id")
        .distinct()
        .join(gold.where("metric_status <> 'PUBLISHED'").select("metric_record_id"),
              "metric_record_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return per_row.unionByName(_named(gaps, "partitions_without_dense_positions")).unionByName(
        _named(unpublished, "unpublished_ranked")
    )
