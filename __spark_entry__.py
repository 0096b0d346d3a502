"""Entry points: a flagship query, every registered query, and their SQL oracles."""

from __future__ import annotations

import importlib
import os
import sys
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from tallymark.contracts import (  # noqa: E402
    BENCHMARK_INPUT_TYPES,
    GOLD_SCHEMA_VERSION,
    IDENTITY,
    OBSERVATION_KEY,
    RANKING_TYPES,
    RAW_COLUMNS,
    SILVER_SCHEMA_VERSION,
)
from tallymark.functions.hashing import (  # noqa: E402
    gold_fingerprint,
    gold_fingerprint_of,
    revision_fingerprint,
    row_digest,
    sha256_lines,
    silver_fingerprint,
    silver_fingerprint_of,
)
from tallymark.errors import IntegrityError, NoMatchingDataError  # noqa: E402
from tallymark.functions.skew import attach_group_facts  # noqa: E402
from tallymark.functions.text import is_string_array, string_array  # noqa: E402
from tallymark.operators import (  # noqa: E402
    audit,
    current_view,
    gold,
    planning,
    quality,
    ranking,
    revision,
    serving,
    silver,
)
from tallymark.operators.bronze import ArtifactMetadata  # noqa: E402
from tallymark.operators.ranking import BenchmarkRequest  # noqa: E402
from tallymark.plans import runs  # noqa: E402
from tallymark.plans.runs import Warehouse  # noqa: E402
from tallymark.session import ensure_checkpoint_dir, shuffles_freed, stage  # noqa: E402
from tallymark.sources import commerce  # noqa: E402
from tallymark.sources.csv_artifact import read_artifacts  # noqa: E402
from tallymark.sources.tables import SnapshotResult, SnapshotTable  # noqa: E402

def _if_present(module: str):
    """The corpus operators and their pipeline may be absent; everything else works without."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as missing:
        if missing.name not in ("corpus_pipeline", "tallymark.llm", "numpy"):
            raise
        return None


corpus_queries = _if_present("tallymark.llm.queries")
corpus_pipeline = _if_present("corpus_pipeline")

PROCESSED_AT = datetime(2026, 3, 4, 5, 6, 7, tzinfo=UTC)

# The artifacts of the two releases and the fingerprints that follow from them.
R1_SHA, R2_SHA = (sha256_lines([label]) for label, _, _ in commerce.RELEASES)
SILVER_PRINT = silver_fingerprint_of([(R1_SHA, R1_SHA), (R2_SHA, R2_SHA)])
GOLD_PRINT = gold_fingerprint_of([SILVER_PRINT])


# --- layers -----------------------------------------------------------------------


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return commerce.bronze_history(spark, folder)


def _bronze(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze as a stored table; it is read several times downstream."""
    return stage(_raw(spark, folder), "bronze")


def _to_silver(history: DataFrame) -> DataFrame:
    return silver.build_silver(
        history,
        fingerprint=SILVER_PRINT,
        processed_at=PROCESSED_AT,
    )


def _silver(spark: SparkSession, folder: str) -> DataFrame:
    return _to_silver(_bronze(spark, folder))


def _to_gold(snapshot: DataFrame, ranges: Iterable[str] = ()) -> DataFrame:
    return gold.build_gold(
        snapshot,
        fingerprint=GOLD_PRINT,
        processed_at=PROCESSED_AT,
        ranges=tuple(ranges),
        silver_fingerprint=SILVER_PRINT,
    )


def _publish_gold(store: SnapshotTable, snapshot: DataFrame) -> SnapshotResult:
    metrics = _to_gold(snapshot, runs.GOLD_LAYOUT["sort"])
    return store.publish(metrics, GOLD_PRINT, GOLD_SCHEMA_VERSION, arranged=True)


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold as a plan, for what reads it once: Silver is then neither stored nor whole."""
    return _to_gold(_silver(spark, folder))


def stored_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Gold as it is published: partitioned by metric, sorted for look-ups.

    Serving reads a stored snapshot. It is built by the first query of a session that
    needs it for these tables, and read by the others.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PUBLISHED:
        store = Warehouse.at(spark, _scratch(spark, "serving")).gold
        _publish_gold(store, _silver(spark, folder))
        _PUBLISHED[key] = store
    return _PUBLISHED[key].read()


_PUBLISHED: dict[tuple[str, str], object] = {}


def _gold_table(spark: SparkSession, folder: str, columns: Iterable[str]) -> DataFrame:
    """Those columns of Gold as a stored table, for what reads them several times."""
    return stage(_gold(spark, folder).select(*columns), "gold")


def _releases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The newer release as candidate and the older one as history."""
    history = _bronze(spark, folder)
    return (
        history.where(F.col("ingestion_id") == R2_SHA),
        history.where(F.col("ingestion_id") == R1_SHA),
    )


# --- result shapes: arrays as text, decimals as rounded doubles ------------------------

METRIC_VALUE = "round(CAST(metric_value AS DOUBLE), 6) AS metric_value"
GOLD_COLUMNS = (
    "metric_record_id",
    *IDENTITY,
    "industry_name_nzsioc",
    "metric_id",
    "metric_name",
    "metric_unit",
    "metric_status",
    METRIC_VALUE,
    "current_input_status",
    "prior_input_status",
    "array_join(source_silver_record_ids, ',') AS record_ids",
)
RANKED_COLUMNS = (
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
    METRIC_VALUE,
    "round(CAST(absolute_metric_value AS DOUBLE), 6) AS absolute_metric_value",
    "metric_record_id",
)
SERVED_COLUMNS = (
    "year",
    "industry_code",
    "industry_name",
    "aggregation_level",
    "metric_id",
    "metric_name",
    "round(metric_value, 6) AS metric_value",
    "metric_status",
    "metric_unit",
    "current_input_status",
    "prior_input_status",
)


# --- Bronze and Silver -----------------------------------------------------------------


def raw_observations(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select(
        *RAW_COLUMNS, "ingestion_id", "source_file", "dataset_year", "dataset_version",
        "row_count", "source_row_number",
    )


def bronze_profile(spark: SparkSession, folder: str) -> DataFrame:
    return audit.bronze_profile(_raw(spark, folder))


def current_rows(spark: SparkSession, folder: str) -> DataFrame:
    history = _bronze(spark, folder)
    return current_view.select_current(history).select(
        *OBSERVATION_KEY, "Value", "ingestion_id", "dataset_year", "source_row_number"
    )


def release_ambiguity(spark: SparkSession, folder: str) -> DataFrame:
    """Both releases claiming the same year: every shared key is a tie."""
    tied = _raw(spark, folder).withColumn("dataset_year", F.lit(2026))
    return current_view.release_ambiguity(tied)


def value_typing(spark: SparkSession, folder: str) -> DataFrame:
    return _silver(spark, folder).selectExpr(
        "record_id", "value_raw", "value_status",
        "CAST(value_numeric AS DOUBLE) AS value_numeric",
    )


def row_validation(spark: SparkSession, folder: str) -> DataFrame:
    return _silver(spark, folder).selectExpr(
        "record_id", "record_status",
        "array_join(validation_rule_ids, ',') AS validation_rule_ids",
    )


def validation_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return silver.failure_distribution(_silver(spark, folder))


def flawed_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Failures by rule of a release in which every row rule is broken somewhere."""
    return silver.failure_distribution(_flawed_silver(spark, folder))


def flawed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each row of that release."""
    return _flawed_silver(spark, folder).selectExpr(
        "record_id", "year", "value_status", "CAST(value_numeric AS DOUBLE) AS value_numeric", "record_status",
        "array_join(validation_rule_ids, ',') AS validation_rule_ids",
        "size(validation_failure_reasons) AS reasons",
    )


def _flawed_silver(spark: SparkSession, folder: str) -> DataFrame:
    return _to_silver(stage(commerce.flawed_release(spark, folder), "flawed"))


def flawed_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All sixteen checks on that release, with values and outcomes of some rows put out of step."""
    place = F.col("source_row_number") % commerce.FLAW_CYCLE
    other = F.when(F.col("record_status") == "VALID", "INVALID").otherwise("VALID")
    altered = _flawed_silver(spark, folder).withColumns(
        {
            "value_numeric": F.when(place != 20, F.col("value_numeric")),
            "record_status": F.when(place == 21, other).otherwise(F.col("record_status")),
        }
    )
    return quality.quality_checks(stage(altered, "altered")).select(
        "check_number", "rule_id", "severity", "status", "affected_rows"
    )


def flawed_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of repeated, renamed and incomplete observations: every status occurs."""
    return _to_gold(_flawed_silver(spark, folder)).selectExpr(*GOLD_COLUMNS[:-1])


def stored_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """The lineage published with Gold of that release: all records behind a metric, repeated ones too."""
    warehouse = Warehouse.at(spark, _scratch(spark, "lineage"))
    warehouse.silver.publish(_flawed_silver(spark, folder), SILVER_PRINT, SILVER_SCHEMA_VERSION)
    runs.refresh_gold(warehouse, clock=lambda: PROCESSED_AT)
    return warehouse.gold.read(table="lineage").drop("source_sha256")


def known_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """All definitions, and what is taken for none of them, as the row rule judges it."""
    rows = _to_silver(stage(commerce.redefined_release(spark, folder), "redefined"))
    unknown = F.array_contains("validation_rule_ids", "VARIABLE_DEFINITION_UNEXPECTED")
    definition = ("variable_code", "variable_name", "variable_category", "units")
    return rows.groupBy(*definition, (~unknown).alias("known")).agg(F.count("*").alias("rows"))


def value_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return silver.status_counts(_silver(spark, folder))


SILVER_COLUMNS = (
    "record_id", *IDENTITY, "industry_name_nzsioc", "industry_code_anzsic06",
    "variable_code", "variable_name", "variable_category", "units", "value_raw",
    "CAST(value_numeric AS DOUBLE) AS value_numeric", "value_status", "is_valid",
    "array_join(validation_rule_ids, ',') AS validation_rule_ids", "ingestion_id",
    "dataset_year", "source_row_count", "source_row_number", "silver_input_fingerprint",
)


def silver_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _silver(spark, folder).selectExpr(*SILVER_COLUMNS)


def silver_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Silver after the second release, from current releases and facts kept since the first."""
    history = _bronze(spark, folder)
    warehouse = Warehouse.at(spark, _scratch(spark, "refresh"))
    for sha in (R1_SHA, R2_SHA):
        rows = history.where(F.col("ingestion_id") == sha)
        runs.append_artifact(warehouse, rows, sha, rows.count())
        runs.refresh_silver(warehouse, clock=lambda: PROCESSED_AT)
    return warehouse.silver.read().selectExpr(*SILVER_COLUMNS)


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    history = _bronze(spark, folder)
    snapshot = stage(_to_silver(history), "silver")
    return quality.quality_checks(snapshot, history).select(
        "check_number", "rule_id", "severity", "status", "affected_rows"
    )


def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    history = _bronze(spark, folder)
    snapshot = stage(_to_silver(history), "silver")
    return quality.quality_summary(snapshot, quality.quality_checks(snapshot, history))


# --- Gold --------------------------------------------------------------------------------


def gold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _gold(spark, folder).selectExpr(*GOLD_COLUMNS)


def direct_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return gold_metrics(spark, folder).where("metric_id IN ('M1', 'M2', 'M3')")


def derived_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return gold_metrics(spark, folder).where("metric_id IN ('M4', 'M5', 'M6')")


def metric_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return gold.metric_lineage(_silver(spark, folder)).drop("source_sha256")


def gold_lineage(spark: SparkSession, folder: str) -> DataFrame:
    snapshot = stage(_silver(spark, folder), "silver")
    return gold.gold_lineage(snapshot, _to_gold(snapshot)).drop("source_sha256")


def metric_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gold.metric_status_counts(_gold(spark, folder))


def level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return gold.level_counts(_gold(spark, folder))


def mixed_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Industry-years split by a newer release that renames one variable's industry."""
    renamed = F.when(
        (F.col("dataset_year") == 2026) & (F.col("variable_code") == "H01"),
        F.concat("industry_name_nzsioc", F.lit(" (renamed)")),
    ).otherwise(F.col("industry_name_nzsioc"))
    return audit.mixed_definitions(
        _silver(spark, folder).withColumn("industry_name_nzsioc", renamed)
    )


# --- rankings and serving ------------------------------------------------------------------


def _rank(ranking_type: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ranked = ranking.rank_changes(_gold(spark, folder), ranking_type=ranking_type, top_n=5)
        return ranked.selectExpr(*RANKED_COLUMNS)

    return query


def rank_whole_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """No bound on N: every eligible row gets its position."""
    kind = "largest_movements"
    metrics = ranking.admitted(_gold(spark, folder), kind).select(*BENCHMARK_INPUT_TYPES)
    ranked = ranking.rank_changes(stage(metrics, "ranked"), ranking_type=kind, top_n=1_000_000_000)
    return ranked.selectExpr(
        "ranking_type", "rank_position", "year", "industry_aggregation_nzsioc", "metric_id",
        "industry_code_nzsioc", METRIC_VALUE,
    )


REQUEST = BenchmarkRequest(2000, "M4", "Level 4", "top_increases")


def benchmark_query(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.benchmark(stored_gold(spark, folder), REQUEST).selectExpr(*RANKED_COLUMNS)


def benchmark_sql(spark: SparkSession, folder: str) -> DataFrame:
    ranked = serving.benchmark_sql(spark, stored_gold(spark, folder), REQUEST)
    return ranked.selectExpr(*RANKED_COLUMNS)


def served_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    request = BenchmarkRequest(2000, "M5", "Level 3", "largest_movements")
    return serving.served_benchmark(stored_gold(spark, folder), request).selectExpr(
        "rank_position", "ranking_type", "year", "industry_code", "industry_name",
        "aggregation_level", "metric_id", "metric_name",
        "round(metric_value, 6) AS metric_value",
        "round(absolute_metric_value, 6) AS absolute_metric_value",
        "metric_status", "metric_unit", "lineage.metric_record_id AS metric_record_id",
    )


def industry_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    return serving.industry_catalogue(stored_gold(spark, folder)).selectExpr(
        "industry_code", "industry_name", "aggregation_level",
        "array_join(transform(available_years, y -> CAST(y AS STRING)), ',') AS available_years",
    )


def catalogue_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return serving.catalogue_sql(spark, stored_gold(spark, folder), year=2000, level="Level 3").selectExpr(
        "industry_code", "industry_name", "aggregation_level",
        "array_join(transform(available_years, y -> CAST(y AS STRING)), ',') AS available_years",
    )


def performance_sql(spark: SparkSession, folder: str) -> DataFrame:
    return serving.performance_sql(
        spark, stored_gold(spark, folder), code="asia", year=2000, level="Level 1"
    ).selectExpr(*SERVED_COLUMNS)


def trend_sql(spark: SparkSession, folder: str) -> DataFrame:
    return serving.trend_sql(
        spark, stored_gold(spark, folder), code="EUROPE", metric_id="M5", level="Level 1",
        start_year=1996, end_year=2001,
    ).selectExpr(*SERVED_COLUMNS)


def industry_performance(spark: SparkSession, folder: str) -> DataFrame:
    return serving.industry_performance(
        stored_gold(spark, folder), code="asia", year=2000, level="Level 1"
    ).selectExpr(*SERVED_COLUMNS)


def industry_trend(spark: SparkSession, folder: str) -> DataFrame:
    trend = serving.industry_trend(
        stored_gold(spark, folder), code="EUROPE", metric_id="M5", level="Level 1",
        start_year=1996, end_year=2001,
    )
    return serving.relative_magnitude(trend).selectExpr(
        *SERVED_COLUMNS, "round(relative_magnitude, 6) AS relative_magnitude"
    )


def lookup_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Look-ups of stored Gold, two of them for what it does not hold: nothing found is an error."""
    metrics = stored_gold(spark, folder)
    lookups = {
        "performance": serving.industry_performance(metrics, code="asia", year=2000, level="Level 1"),
        "trend": serving.industry_trend(metrics, code="EUROPE", metric_id="M5", level="Level 1"),
        "other level": serving.industry_performance(metrics, code="asia", year=2000, level="Level 3"),
        "other year": serving.industry_catalogue(metrics, year=2024),
    }
    found = []
    for name, rows in lookups.items():
        try:
            found.append((name, "FOUND", serving.require_matches(rows, name).count()))
        except NoMatchingDataError:
            found.append((name, "NO_MATCH", 0))
    return spark.createDataFrame(found, "lookup STRING, outcome STRING, rows BIGINT")


def trend_magnitudes(spark: SparkSession, folder: str) -> DataFrame:
    """Relative magnitudes of every series at once."""
    served = _gold(spark, folder).selectExpr(*serving.SERVED_METRIC)
    return serving.relative_magnitude(served).selectExpr(
        "year", "industry_code", "aggregation_level", "metric_id",
        "round(relative_magnitude, 6) AS relative_magnitude",
    )


def published_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return serving.published_coverage(_gold(spark, folder))


def string_array_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Lineage arrays through JSON text and back."""
    text = _gold(spark, folder).selectExpr(
        "metric_record_id", "to_json(source_silver_record_ids) AS text"
    )
    parsed = text.selectExpr("metric_record_id", f"{string_array('text')} AS items")
    return parsed.selectExpr(
        "metric_record_id", "array_join(items, ',') AS record_ids",
        "CAST(size(items) AS BIGINT) AS items",
    )


# --- revisions, planning, audits -------------------------------------------------------------


def overlap_and_change(spark: SparkSession, folder: str) -> DataFrame:
    return revision.overlap_and_change(*_releases(spark, folder))


def _pairs(spark: SparkSession, folder: str) -> revision.ObservationPairs:
    return revision.observation_pairs(*_releases(spark, folder))


def revision_counts(spark: SparkSession, folder: str) -> DataFrame:
    return revision.revision_counts(_pairs(spark, folder))


def value_transitions(spark: SparkSession, folder: str) -> DataFrame:
    return revision.value_transitions(_pairs(spark, folder))


def previous_releases(spark: SparkSession, folder: str) -> DataFrame:
    return revision.previous_releases(_pairs(spark, folder), 2026).select(
        "release_identity", "dataset_year", "source_file", "overlapping_observations",
        "superseded",
    )


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Silver, Gold and revision fingerprints, derived from the stored artifacts."""
    history = _bronze(spark, folder)
    of_silver = silver_fingerprint(history)
    of_gold = gold_fingerprint(of_silver, "fingerprint")
    of_revision = revision_fingerprint(history, R2_SHA)
    named = ((of_silver, "silver"), (of_gold, "gold"), (of_revision, "revision"))
    return reduce(DataFrame.unionByName, [f.select(F.lit(name).alias("name"), "fingerprint") for f, name in named])


def row_digests(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(spark, folder).select(
        *OBSERVATION_KEY, "dataset_version", row_digest().alias("digest")
    )


def incremental_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Both releases stored, Silver and Gold still built from the older one."""
    history = _bronze(spark, folder)
    candidate, older = (history.where(F.col("ingestion_id") == sha) for sha in (R2_SHA, R1_SHA))
    of_silver = silver_fingerprint(older)
    return planning.incremental_plan(
        R2_SHA,
        R2_SHA,
        artifacts=history.select("ingestion_id", "source_sha256"),
        silver_fingerprints=of_silver,
        gold_fingerprints=gold_fingerprint(of_silver, "fingerprint"),
        overlap=revision.overlap_and_change(candidate, older),
    ).selectExpr(
        "layer_order", "layer", "action",
        "array_join(current_identities, ',') AS current_identities", "expected_identity",
        "pipeline_status", "artifact_status",
    )


def deferred_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The newer release offered to an incremental load that holds the older one."""
    candidate, older = _releases(spark, folder)
    of_silver = silver_fingerprint(older)
    return planning.incremental_plan(
        R2_SHA,
        R2_SHA,
        artifacts=older.select("ingestion_id", "source_sha256"),
        silver_fingerprints=of_silver,
        gold_fingerprints=gold_fingerprint(of_silver, "fingerprint"),
        overlap=revision.overlap_and_change(candidate, older),
    ).selectExpr(
        "layer_order", "layer", "action", "size(current_identities) AS current_identities", "expected_identity",
        "pipeline_status", "artifact_status", "overlap_observations", "changed_existing_observations",
    )


def revision_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What a release is taken for: newer than what it overlaps, older, or of other industries."""
    newer, older = _releases(spark, folder)
    moved = F.concat(F.lit("X"), "Industry_code_NZSIOC")
    cases = {
        "newer": (newer, older, R2_SHA, 2026),
        "older": (older, newer, R1_SHA, 2025),
        "other": (newer.withColumn("Industry_code_NZSIOC", moved), older, R2_SHA, 2026),
    }
    found = []
    for case, (candidate, history, sha, year) in cases.items():
        metadata = ArtifactMetadata(sha, "f", "u", sha, year, f"v{year}", PROCESSED_AT.isoformat(), 1)
        report = runs.analyze_revision(candidate, history, metadata)
        found.append((case, report.overall_result, *(getattr(report, name) for name in runs.COUNTERS)))
    counters = ", ".join(f"{name} BIGINT" for name in runs.COUNTERS)
    return spark.createDataFrame(found, f"case STRING, overall_result STRING, {counters}")


def hot_group_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Group sizes attached to rows where one key holds a third of them, through the salted branch."""
    hot = F.when(F.col("source_row_number") % 3 == 0, "HOT").otherwise(F.col("Industry_code_NZSIOC"))
    rows = _bronze(spark, folder).select(hot.alias("code"), "Variable_code")
    sizes = rows.groupBy("code").agg(F.count("*").alias("code_rows"))
    attached = attach_group_facts(rows, sizes, ["code"], "code_rows", hot_min_rows=1_000)
    return attached.groupBy("code", "Variable_code", "code_rows").agg(F.count("*").alias("rows"))


#: Texts in place of a JSON array of strings; only the first three are one.
ARRAY_TEXTS = ('["a","b"]', "[]", None, "[1]", "[null]", '["a",]', '{"a":1}', "a,b", "", '["a"] x')


def string_array_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """Array texts of which most are no array of strings, over all observations."""
    texts = ", ".join("NULL" if t is None else f"'{t}'" for t in ARRAY_TEXTS)
    rows = _raw(spark, folder).selectExpr(f"CAST(source_row_number % {len(ARRAY_TEXTS)} AS INT) AS kind")
    read = rows.selectExpr("kind", f"array({texts})[kind] AS text").selectExpr(
        "kind", f"{is_string_array('text')} AS accepted", f"array_join({string_array('text')}, '|') AS items"
    )
    return read.groupBy("kind", "accepted", "items").agg(F.count("*").alias("rows"))


def audit_silver(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_silver(_silver(spark, folder))


def audit_gold(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_gold(_gold(spark, folder))


def acceptance_points(spark: SparkSession, folder: str) -> DataFrame:
    """Total income of whole regions, as their current rows state it, held against the metric; one year in three is stated wrongly."""
    history = _bronze(spark, folder)
    stated = F.regexp_replace("Value", ",", "").cast("bigint")
    wrong = F.when(F.col("Year").cast("int") % 3 == 0, 1).otherwise(0)
    points = current_view.select_current(history).where("Variable_code = 'H01' AND Industry_aggregation_NZSIOC = 'Level 1'")
    expected = points.select(
        F.col("Year").cast("int").alias("year"),
        F.col("Industry_aggregation_NZSIOC").alias("industry_aggregation_nzsioc"),
        F.col("Industry_code_NZSIOC").alias("industry_code_nzsioc"),
        F.lit("M1").alias("metric_id"),
        (stated + wrong).cast("string").alias("expected_value"),
        F.lit(None).cast("int").alias("decimals"),
        F.lit("PUBLISHED").alias("expected_status"),
    )
    return audit.acceptance_points(_to_gold(stage(_to_silver(history), "silver")), expected).select(
        *IDENTITY, "metric_id", "expected_value", "metric_status", "verified"
    )


def bronze_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Stored Bronze, read back: its columns in order, their types, and how many rows fill each."""
    bronze = Warehouse.at(spark, _scratch(spark, "contract")).bronze
    history = _bronze(spark, folder)
    for sha in (R1_SHA, R2_SHA):
        rows = history.where(F.col("ingestion_id") == sha)
        bronze.append(rows, sha, rows.count())
    stored = bronze.read()
    types = ", ".join(
        f"struct({i} AS position, '{f.name}' AS name, '{f.dataType.simpleString()}' AS type, `{f.name}` AS filled)"
        for i, f in enumerate(stored.schema, 1)
    )
    return stored.agg(*(F.count(name).alias(name) for name in stored.columns)).selectExpr(f"inline(array({types}))")


def audit_rankings(spark: SparkSession, folder: str) -> DataFrame:
    metrics = _gold_table(spark, folder, BENCHMARK_INPUT_TYPES)
    rankings = [
        ranking.rank_changes(metrics, ranking_type=kind, top_n=3) for kind in RANKING_TYPES
    ]
    return audit.audit_rankings(rankings, metrics)


def lineage_audit(spark: SparkSession, folder: str) -> DataFrame:
    history = _bronze(spark, folder)
    return audit.lineage_audit(_to_silver(history), history)


# --- sources and sinks ---------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write_csv(rows: DataFrame, path: str) -> str:
    (
        rows.select(*RAW_COLUMNS)
        .write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def csv_ingest_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Observations written as CSV files, each read back as a strict artifact."""
    path = _write_csv(_raw(spark, folder), _scratch(spark, "csv"))
    return read_artifacts(spark, path).groupBy(*RAW_COLUMNS).agg(
        F.count(F.lit(1)).alias("copies")
    )


def csv_artifact_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Row numbers, counts and digests of CSV artifacts, one row over all files."""
    path = _write_csv(_raw(spark, folder), _scratch(spark, "csv"))
    per_file = read_artifacts(spark, path).groupBy("source_file", "source_sha256", "row_count").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("source_row_number").alias("low"),
        F.max("source_row_number").alias("high"),
        F.sum("source_row_number").alias("total"),
    )
    sound = "rows = row_count AND low = 1 AND high = rows AND total = rows * (rows + 1) DIV 2"
    return per_file.agg(
        F.sum("rows").alias("rows"),
        F.expr(f"count_if(NOT ({sound}))").alias("files_with_wrong_numbers"),
        F.expr("count_if(NOT source_sha256 RLIKE '^[0-9A-F]{64}$')").alias("files_without_digest"),
    )


def csv_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """One file per release and year whose fields hold line breaks and quotes, read in three blocks each."""
    name = """CASE Variable_code WHEN 'H23' THEN concat(Industry_name_NZSIOC, '\n"', Industry_code_NZSIOC, '"')
        WHEN 'H40' THEN concat(Industry_name_NZSIOC, ',\r\n,') ELSE Industry_name_NZSIOC END"""
    path, own = _scratch(spark, "csv-breaks"), ["release", "of_year"]
    rows = _raw(spark, folder).withColumns(
        {"Industry_name_NZSIOC": F.expr(name), "release": F.col("dataset_year"), "of_year": F.col("Year")}
    )
    files = rows.repartition(*own).sortWithinPartitions(*own, "source_row_number").select(*RAW_COLUMNS, *own)
    exact = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    with shuffles_freed(spark):
        files.write.options(**exact).partitionBy(*own).csv(path)
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(-(-longest // 3)))
    try:
        return stage(read_artifacts(spark, path).drop("source_file"), "csv-breaks")
    finally:
        spark.conf.set(setting, before)


def load_runs(spark: SparkSession, folder: str) -> DataFrame:
    """An initial load, the same artifact again, a revision, and the revision again."""
    history = _bronze(spark, folder)
    releases = []
    for label, year, version in commerce.RELEASES:
        # A release is one file.
        rows = history.where(F.col("dataset_year") == year).coalesce(1)
        path = _write_csv(rows, _scratch(spark, f"release-{label}"))
        releases.append(runs.Release(path, f"https://releases.example/{label}", year, version))
    warehouse = Warehouse.at(spark, _scratch(spark, "load-runs"))

    def row(step: int, run: str, status: str, loaded, rejected: int = 0):
        counts = (loaded.bronze.total_rows if loaded.bronze else 0, *(x.rows if x else 0 for x in (loaded.silver, loaded.gold)))
        return (step, run, status, *counts, rejected)

    first = runs.run_initial_load(warehouse, releases[0])
    again = runs.run_incremental(warehouse, releases[0])
    revised = runs.run_revision(warehouse, releases[1])
    known = runs.run_revision(warehouse, releases[1])
    return spark.createDataFrame(
        [
            row(1, "initial", "LOADED", first, first.quality["rows_rejected"]),
            row(2, "incremental", again.status, again.loaded),
            row(3, "revision", revised.report.overall_result, revised.loaded),
            row(4, "revision", f"{known.report.overall_result}, known: {str(known.duplicate).lower()}", known.loaded),
        ],
        "step INT, run STRING, status STRING, bronze_rows BIGINT, silver_rows BIGINT, gold_rows BIGINT, rejected BIGINT",
    )


def idempotent_append(spark: SparkSession, folder: str) -> DataFrame:
    """Each release appended twice; the second time nothing is inserted."""
    history = _bronze(spark, folder)
    bronze = Warehouse.at(spark, _scratch(spark, "append")).bronze
    results = []
    for sha in (R1_SHA, R2_SHA):
        rows = history.where(F.col("ingestion_id") == sha)
        expected = rows.count()
        results += [bronze.append(rows, sha, expected) for _ in range(2)]
    return spark.createDataFrame(
        [(r.ingestion_id, r.inserted_rows, r.total_rows, r.duplicate) for r in results],
        "ingestion_id STRING, inserted_rows BIGINT, total_rows BIGINT, duplicate BOOLEAN",
    )


def catalog_retry(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog tables after failed writes: what a failure left is not read, and a retry leaves one copy."""
    schema = f"tallymark_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{_scratch(spark, 'catalog')}'")
    warehouse = Warehouse.in_catalog(spark, schema)
    history, steps = _bronze(spark, folder), []
    rows = history.where(F.col("ingestion_id") == R1_SHA)
    expected = rows.count()

    def step(name: str, table, duplicate: bool) -> None:
        steps.append((len(steps) + 1, name, table.read().count() if table.exists() else 0, duplicate))

    runs.append_artifact(warehouse, history.where(F.col("ingestion_id") == R2_SHA), R2_SHA, history.count() - expected)
    warehouse.bronze.store.write_attempt(rows, "ingestion_id")
    step("append without commit", warehouse.bronze, False)
    for name in ("append", "append again"):
        step(name, warehouse.bronze, runs.append_artifact(warehouse, rows, R1_SHA, expected).duplicate)
    # Written twice, made once.
    snapshot = stage(_to_silver(history), "silver")
    try:
        warehouse.silver.publish(snapshot, SILVER_PRINT, SILVER_SCHEMA_VERSION, 1)
    except IntegrityError:
        step("snapshot with a wrong count", warehouse.silver, False)
    for name in ("snapshot", "snapshot again"):
        step(name, warehouse.silver, warehouse.silver.publish(snapshot, SILVER_PRINT, SILVER_SCHEMA_VERSION).duplicate)
    return spark.createDataFrame(steps, "step INT, name STRING, visible BIGINT, duplicate BOOLEAN")


def snapshot_rerun(spark: SparkSession, folder: str) -> DataFrame:
    """Silver and Gold snapshots published twice; the second time they are reused."""
    warehouse = Warehouse.at(spark, _scratch(spark, "snapshots"))
    snapshot = _silver(spark, folder)
    results = [
        ("silver", warehouse.silver.publish(snapshot, SILVER_PRINT, SILVER_SCHEMA_VERSION))
        for _ in range(2)
    ]
    results += [("gold", _publish_gold(warehouse.gold, warehouse.silver.read())) for _ in range(2)]
    return spark.createDataFrame(
        [(layer, r.fingerprint, r.rows, r.duplicate) for layer, r in results],
        "layer STRING, fingerprint STRING, rows BIGINT, duplicate BOOLEAN",
    )


# --- driver contract -----------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Largest year-over-year movements per year, metric and level."""
    return _rank("largest_movements")(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        raw_observations, bronze_profile, release_ambiguity, value_typing, row_validation,
        validation_distribution, value_status_counts, silver_snapshot, quality_report,
        quality_summary, direct_metrics, derived_metrics, gold_metrics, metric_lineage,
        flawed_distribution, flawed_rows, gold_lineage, catalogue_filtered, performance_sql, trend_sql,
        metric_status_counts, level_counts, mixed_definitions, rank_whole_partitions,
        benchmark_query, benchmark_sql, served_benchmark, industry_catalogue,
        industry_performance, industry_trend, trend_magnitudes, published_coverage,
        overlap_and_change, revision_counts, value_transitions, previous_releases,
        fingerprints, row_digests, incremental_plan, audit_silver, audit_gold,
        audit_rankings, lineage_audit, string_array_normalise, csv_ingest_roundtrip,
        idempotent_append, snapshot_rerun, csv_artifact_facts, csv_line_breaks, load_runs,
        flawed_quality, flawed_gold, stored_lineage, silver_refresh, deferred_plan, revision_outcomes,
        hot_group_facts, string_array_malformed, catalog_retry, acceptance_points, bronze_contract, known_definitions, lookup_outcomes,
    )
    return {
        "current_view": current_rows,
        **{f"rank_{kind}": _rank(kind) for kind in RANKING_TYPES},
        **{query.__name__: query for query in plain},
        **(corpus_queries.queries() if corpus_queries else {}),
        **({"pipeline": corpus_pipeline.run} if corpus_pipeline else {}),
    }


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline and corpus_pipeline.ORACLE_SQL else {}
    return {**oracles.oracle_sql(), **(corpus_queries.oracle_sql() if corpus_queries else {}), **whole}
