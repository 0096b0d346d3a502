"""Gold: three published metrics and their yearly change per industry and year."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.contracts import (
    GOLD_SCHEMA_VERSION,
    GOLD_TYPES,
    IDENTITY,
    METRICS,
    SILVER_TYPES,
    VALUE_TYPE,
    Metric,
)
from tallymark.functions.text import quoted, quoted_list
from tallymark.operators.bronze import iso_instant
from tallymark.operators.schema_check import EXACT, check_schema
from tallymark.session import keep_methods_compiled

# A metric row names its record where there is one. A repeated observation has no usable
# value and any number of records: those are listed, one row each, by ``gold_lineage``.
_LINEAGE = {
    "record_ids": "record_id",
    "ingestion_ids": "ingestion_id",
    "sha256s": "source_sha256",
}

#: What a direct metric is made of: parts of its record, and what a yearly change reads.
_RECORD = ("value_status", "is_valid", "value_numeric", *_LINEAGE.values())
_INPUTS = ("status", "value", *_LINEAGE)

COMPLETE_IDENTITY = "(" + " AND ".join(f"{name} IS NOT NULL" for name in IDENTITY) + ")"
NO_STRINGS = "CAST(array() AS array<string>)"


def build_gold(
    silver: DataFrame,
    *,
    fingerprint: str,
    processed_at: datetime,
    ranges: Sequence[str] = (),
    silver_fingerprint: str | None = None,
) -> DataFrame:
    """Six metric rows (M1-M6) per observed industry and year, each with a status.

    Silver is read and aggregated once. Name the ``silver_fingerprint`` where all of its
    rows have the same: it is then not collected for every industry and year. With ``ranges`` the rows come in ranges of those
    parts of their identity, sorted by metric and then by them: industry-years are dealt
    out before each becomes six rows, and what follows from a row is added last.
    """
    check_schema(silver, SILVER_TYPES, EXACT, "Silver")
    keep_methods_compiled(silver.sparkSession)
    # Every input is a column, so that what a query does not read is never computed.
    paired = with_prior_year(direct_inputs(silver, silver_fingerprint))
    paired = paired.repartitionByRange(*ranges) if ranges else paired
    metric_rows = _unpivoted(paired)
    metric_rows = metric_rows.sortWithinPartitions("metric_id", *ranges) if ranges else metric_rows
    labels = {_id(label): label for label in (*map(_direct_labels, METRICS), *map(_change_labels, METRICS))}
    names = [name for name in next(iter(labels.values())) if name != "metric_id"]
    by_metric = {
        name: "CASE metric_id " + " ".join(f"WHEN {i} THEN {label[name]}" for i, label in labels.items()) + " END" for name in names
    }
    version = quoted(fingerprint)
    gold = {
        "metric_record_id": metric_record_id(version),
        **by_metric,
        "source_silver_record_ids": "array_union(current_input_record_ids, prior_input_record_ids)",
        "gold_schema_version": quoted(GOLD_SCHEMA_VERSION),
        "gold_input_fingerprint": version,
        "gold_processing_timestamp": f"TIMESTAMP {quoted(iso_instant(processed_at))}",
    }
    return metric_rows.selectExpr(*[f"{gold.get(name, name)} AS {name}" for name in GOLD_TYPES])


def metric_record_id(fingerprint: str) -> str:
    """A metric row's id, as SQL, from Gold's fingerprint and what names the row."""
    return f"""sha2(concat_ws('|', {fingerprint},
        coalesce(CAST(year AS STRING), '<null>'), industry_aggregation_nzsioc,
        industry_code_nzsioc, metric_id), 256)"""


def with_prior_year(inputs: DataFrame) -> DataFrame:
    """Add what an industry's row of exactly the year before holds, as ``_prior_`` columns.

    An industry has one row a year here, so that row is the one before or there is none:
    a gap in the years is never bridged.
    """
    industry = Window.partitionBy("industry_code_nzsioc", "industry_aggregation_nzsioc").orderBy("year")
    names = [*(f"{m.direct_id}_{part}" for m in METRICS for part in _INPUTS), "silver_input_fingerprints"]
    follows = F.expr(COMPLETE_IDENTITY) & (F.lag("year").over(industry) + 1 == F.col("year"))
    return inputs.withColumns({f"_prior_{name}": F.when(follows, F.lag(name).over(industry)) for name in names})


def _unpivoted(paired: DataFrame) -> DataFrame:
    """One row per metric from one per industry-year: no row carries another metric's columns."""
    rows = {_id(label): row for label, row in (
        *((_direct_labels(m), _direct_row(m)) for m in METRICS), *((_change_labels(m), _change_row(m)) for m in METRICS),
    )}
    parts = list(next(iter(rows.values())))
    # Equal expressions are one column, whichever metrics they stand in.
    columns = {text: f"_c{i}" for i, text in enumerate(dict.fromkeys(row[part] for row in rows.values() for part in parts))}
    kept = (*IDENTITY, "industry_name_nzsioc", "industry_code_anzsic06")
    wide = paired.selectExpr(*kept, *(f"{text} AS {name}" for text, name in columns.items()))
    groups = ", ".join(f"({', '.join(columns[row[part]] for part in parts)}) AS {i[1:-1]}" for i, row in rows.items())
    unpivot = f"UNPIVOT INCLUDE NULLS (({', '.join(parts)}) FOR metric_id IN ({groups}))"
    return paired.sparkSession.sql(f"SELECT * FROM {{wide}} {unpivot}", wide=wide)


def _id(label: dict[str, str]) -> str:
    return label["metric_id"]


def direct_inputs(silver: DataFrame, silver_fingerprint: str | None = None) -> DataFrame:
    """One row per industry and year with columns ``M1_status``, ``M1_value`` and so on.

    Each direct metric has ``status``, ``value``, ``record_ids``, ``ingestion_ids`` and
    ``sha256s``. All three metrics come from one aggregation that combines map-side
    and keeps a single record per metric: the parts of a record are least values of their
    own, which are one record's wherever a metric has one, and not read elsewhere. No set
    is collected where the ``silver_fingerprint`` is known: beyond 128 groups in a task
    Spark would sort objects for it.
    """
    aggregates = [
        "count(*) AS _rows",
        "min(industry_name_nzsioc) AS industry_name_nzsioc",
        "max(industry_name_nzsioc) AS _last_name",
        "count(industry_name_nzsioc) AS _named",
        "min(industry_code_anzsic06) AS industry_code_anzsic06",
        "max(industry_code_anzsic06) AS _last_anzsic",
        "count(industry_code_anzsic06) AS _mapped",
    ]
    if silver_fingerprint is None:
        aggregates.append("sort_array(collect_set(silver_input_fingerprint)) AS _fingerprints")
    prints = "_fingerprints" if silver_fingerprint is None else f"array({quoted(silver_fingerprint)})"
    for metric in METRICS:
        selected = f"variable_code = {quoted(metric.variable_code)}"
        described = (
            f"variable_name = {quoted(metric.name)} "
            f"AND variable_category = {quoted(metric.category)} "
            f"AND units = {quoted(metric.source_units)}"
        )
        aggregates += [
            f"count_if({selected}) AS _n_{metric.direct_id}",
            f"count_if({selected} AND {described}) AS _described_{metric.direct_id}",
            *(f"min(CASE WHEN {selected} THEN {part} END) AS _{part}_{metric.direct_id}" for part in _RECORD),
        ]
    # Codes tell most rows apart, so they come first where rows are sorted.
    grouped = silver.groupBy(*reversed(IDENTITY)).agg(*map(F.expr, aggregates))
    statuses = {f"{m.direct_id}_status": F.expr(_direct_status(m)) for m in METRICS}
    return grouped.withColumns(statuses).selectExpr(
        *IDENTITY,
        "industry_name_nzsioc",
        "industry_code_anzsic06",
        f"{prints} AS silver_input_fingerprints",
        *[f"{text} AS {m.direct_id}_{part}" for m in METRICS for part, text in _direct_parts(m).items()],
    )


def metric_lineage(silver: DataFrame) -> DataFrame:
    """Every record behind every direct metric, one row each (no shuffle, no limit).

    A change metric depends on its direct metric's records of the same year and of
    the year before.
    """
    names = " ".join(
        f"WHEN {quoted(metric.variable_code)} THEN {quoted(metric.direct_id)}"
        for metric in METRICS
    )
    return _input_rows(silver).selectExpr(
        *IDENTITY, f"CASE variable_code {names} END AS metric_id", *_LINEAGE.values()
    )


def gold_lineage(silver: DataFrame, gold: DataFrame, *, arranged: bool = False) -> DataFrame:
    """``metric_record_id, metric_id, role`` and the record behind it, for all six metrics.

    A direct metric has its records in role ``current``; a change also those of the year
    before, as ``prior``. AQE splits a metric that very many records stand behind. Metric
    ids are computed, so Gold only says which of them exist, and what names a record, not its
    digest, is shuffled. ``arranged`` rows come in ranges and sorted by record. Neither side
    may be broadcast: Parquet holds millions of such rows in what a planner takes for a small table.
    """
    changes = " ".join(f"WHEN {quoted(m.direct_id)} THEN {quoted(m.change_id)}" for m in METRICS)
    change = f"CASE metric_id {changes} END"
    roles = f"""array(
        struct(year AS year, metric_id AS metric_id, 'current' AS role),
        struct(year AS year, {change} AS metric_id, 'current' AS role),
        struct(year + 1 AS year, {change} AS metric_id, 'prior' AS role))"""
    rows = metric_lineage(silver).selectExpr(
        f"inline({roles}) AS (metric_year, of_metric, role)", *IDENTITY[1:], *_LINEAGE.values(),
    )
    # What tells rows apart comes first, as it is sorted.
    key = [*reversed(IDENTITY), "metric_id"]
    owners = gold.select(*key, "gold_input_fingerprint")
    named = rows.withColumnsRenamed({"metric_year": "year", "of_metric": "metric_id"}).join(owners.hint("merge"), key)
    record = metric_record_id("gold_input_fingerprint")
    named = named.repartitionByRange(F.expr(record)) if arranged else named
    found = named.selectExpr(f"{record} AS metric_record_id", "metric_id", "role", *_LINEAGE.values())
    return found.sortWithinPartitions("metric_record_id") if arranged else found


def _input_rows(silver: DataFrame) -> DataFrame:
    codes = quoted_list(metric.variable_code for metric in METRICS)
    return silver.where(f"variable_code IN ({codes}) AND {COMPLETE_IDENTITY}")


def _records(metric: Metric) -> str:
    """How many records a direct metric has; an identity with a null part is never matched to one."""
    return f"(CASE WHEN {COMPLETE_IDENTITY} THEN _n_{metric.direct_id} ELSE 0 END)"


def _direct_status(metric: Metric) -> str:
    """Status of one direct metric, from the grouped columns."""
    n, m = _records(metric), metric.direct_id
    one_definition = """(industry_name_nzsioc <=> _last_name
        AND industry_code_anzsic06 <=> _last_anzsic
        AND _named IN (0, _rows) AND _mapped IN (0, _rows))"""
    return f"""CASE
        WHEN NOT {one_definition} THEN 'INVALID_VALUE'
        WHEN {n} = 0 THEN 'UNAVAILABLE'
        WHEN {n} > 1 THEN 'INVALID_DUPLICATE'
        WHEN _described_{m} <> 1 THEN 'INVALID_VALUE'
        WHEN _value_status_{m} IN ('CONFIDENTIAL', 'SUPPRESSED', 'UNAVAILABLE')
            THEN _value_status_{m}
        WHEN _value_status_{m} = 'PUBLISHED' AND _is_valid_{m}
            AND _value_numeric_{m} IS NOT NULL THEN 'PUBLISHED'
        ELSE 'INVALID_VALUE' END"""


def _direct_parts(metric: Metric) -> dict[str, str]:
    """Status, value and lineage of one direct metric, from the grouped columns and the status."""
    n, m = _records(metric), metric.direct_id
    lineage = {
        name: f"CASE WHEN {n} = 1 THEN array_compact(array(_{source}_{m})) ELSE {NO_STRINGS} END"
        for name, source in _LINEAGE.items()
    }
    value = f"CASE WHEN {m}_status = 'PUBLISHED' THEN _value_numeric_{m} END"
    return {"status": f"{m}_status", "value": value, **lineage}


def _direct_labels(metric: Metric) -> dict[str, str]:
    return _labels(metric, metric.direct_id, metric.name, "DIRECT", metric.unit)


def _change_labels(metric: Metric) -> dict[str, str]:
    return _labels(metric, metric.change_id, metric.change_name, "DERIVED", metric.change_unit)


def _direct_row(metric: Metric) -> dict[str, str]:
    m = metric.direct_id
    return {
        "metric_value": f"{m}_value",
        "metric_status": f"{m}_status",
        "current_input_status": f"{m}_status",
        "current_input_value": f"{m}_value",
        "current_input_record_ids": f"{m}_record_ids",
        "prior_input_status": "CAST(NULL AS STRING)",
        "prior_input_value": f"CAST(NULL AS {VALUE_TYPE})",
        "prior_input_record_ids": NO_STRINGS,
        "source_ingestion_ids": f"{m}_ingestion_ids",
        "source_sha256s": f"{m}_sha256s",
        "silver_input_fingerprints": "silver_input_fingerprints",
    }


def _change_row(metric: Metric) -> dict[str, str]:
    m, before = metric.direct_id, f"_prior_{metric.direct_id}"
    status, value = change_of(
        f"{m}_status", f"{m}_value", f"{before}_status", f"{before}_value",
        percent=metric.change_is_percent,
    )

    def merged(name: str) -> str:
        return f"array_union({m}_{name}, coalesce({before}_{name}, {NO_STRINGS}))"

    return {
        "metric_value": value,
        "metric_status": status,
        "current_input_status": f"{m}_status",
        "current_input_value": f"{m}_value",
        "current_input_record_ids": f"{m}_record_ids",
        "prior_input_status": f"coalesce({before}_status, 'UNAVAILABLE')",
        "prior_input_value": f"{before}_value",
        "prior_input_record_ids": f"coalesce({before}_record_ids, {NO_STRINGS})",
        "source_ingestion_ids": merged("ingestion_ids"),
        "source_sha256s": merged("sha256s"),
        "silver_input_fingerprints": f"""array_union(silver_input_fingerprints,
            coalesce(_prior_silver_input_fingerprints, {NO_STRINGS}))""",
    }


def change_of(
    status: str, value: str, prior_status: str, prior_value: str, *, percent: bool
) -> tuple[str, str]:
    """Status and value of a yearly change, as SQL expressions.

    Percentages are computed in double: decimal division keeps six decimals only.
    """
    both = f"coalesce({status} = 'PUBLISHED' AND {prior_status} = 'PUBLISHED', false)"
    meaningful = f"WHEN {prior_value} <= 0 THEN 'NOT_MEANINGFUL_BASE'" if percent else ""
    outcome = f"CASE WHEN NOT {both} THEN 'UNAVAILABLE_INPUT' {meaningful} ELSE 'PUBLISHED' END"
    change = f"{value} - {prior_value}"
    if percent:
        base = f"CAST({prior_value} AS DOUBLE)"
        change = f"(CAST({value} AS DOUBLE) - {base}) * 100 / {base}"
    return outcome, f"CASE WHEN {outcome} = 'PUBLISHED' THEN CAST({change} AS {VALUE_TYPE}) END"


def _labels(metric: Metric, metric_id: str, name: str, kind: str, unit: str) -> dict[str, str]:
    texts = {
        "metric_id": metric_id,
        "metric_name": name,
        "metric_type": kind,
        "metric_unit": unit,
        "source_variable_code": metric.variable_code,
        "source_variable_name": metric.name,
        "source_variable_category": metric.category,
        "source_variable_units": metric.source_units,
    }
    return {column: quoted(text) for column, text in texts.items()}


METRIC_STATUSES = (
    "PUBLISHED", "CONFIDENTIAL", "SUPPRESSED", "UNAVAILABLE", "INVALID_VALUE", "INVALID_DUPLICATE",
    "UNAVAILABLE_INPUT", "NOT_MEANINGFUL_BASE",
)


def snapshot_counts() -> dict[str, Column]:
    """Counts of statuses, to be taken while Gold is written."""
    return {f"status:{status}": F.count_if(F.col("metric_status") == status) for status in METRIC_STATUSES}


def metric_status_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("metric_id", "metric_status").agg(F.count(F.lit(1)).alias("rows"))


def level_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy("industry_aggregation_nzsioc").agg(F.count(F.lit(1)).alias("rows"))
