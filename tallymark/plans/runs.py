"""Driver functions that run whole loads: initial, incremental and revision."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.contracts import (
    GOLD_SCHEMA_VERSION,
    GOLD_TYPES,
    PRECEDENCE_RULE,
    RAW_SCHEMA_VERSION,
    SILVER_SCHEMA_VERSION,
    SILVER_TYPES,
)
from tallymark.errors import DuplicateKeyError, IntegrityError, SourceTableError
from tallymark.functions.hashing import (
    gold_fingerprint_of,
    revision_id_of,
    silver_fingerprint,
)
from tallymark.operators.bronze import ArtifactMetadata, iso_instant, to_bronze
from tallymark.operators.current_view import CURRENT_TYPES, current_releases, merged_releases, require_unambiguous
from tallymark.operators.gold import build_gold, gold_lineage, snapshot_counts as gold_counts
from tallymark.operators.planning import incremental_plan
from tallymark.operators.quality import quality_checks, quality_summary
from tallymark.operators.revision import (
    observation_pairs,
    overlap_and_change,
    previous_releases,
    revision_counts,
    value_transitions,
)
from tallymark.operators.silver import build_silver, snapshot_counts as silver_counts
from tallymark.session import stage
from tallymark.sources.csv_artifact import read_artifact
from tallymark.sources.tables import (
    AppendResult,
    ArtifactRegistry,
    BronzeTable,
    CatalogStore,
    PathStore,
    SnapshotResult,
    SnapshotTable,
)

Clock = Callable[[], datetime]


def utc_now() -> datetime:
    return datetime.now(UTC)


#: Look-ups name a metric, then a level, a year and a code; lineage is asked for by record.
GOLD_LAYOUT = {
    "partition": "metric_id",
    "sort": ("industry_aggregation_nzsioc", "year", "industry_code_nzsioc"),
    # It comes in the order of its records.
    "beside": {"lineage": ()},
}


@dataclass
class Warehouse:
    """The tables one deployment works on."""

    spark: SparkSession
    registry: ArtifactRegistry
    bronze: BronzeTable
    #: The current release of every observation key in Bronze.
    current: SnapshotTable
    silver: SnapshotTable
    gold: SnapshotTable
    quality: PathStore | CatalogStore
    revisions: PathStore | CatalogStore

    @classmethod
    def at(cls, spark: SparkSession, root: str, fmt: str = "parquet") -> Warehouse:
        """Tables in folders under ``root``."""
        root = root.rstrip("/")
        return cls(
            spark,
            ArtifactRegistry(PathStore(spark, f"{root}/artifacts", fmt)),
            BronzeTable(PathStore(spark, f"{root}/bronze", fmt)),
            SnapshotTable(spark, f"{root}/current", CURRENT_TYPES, fmt),
            SnapshotTable(spark, f"{root}/silver", SILVER_TYPES, fmt),
            SnapshotTable(spark, f"{root}/gold", GOLD_TYPES, fmt, **GOLD_LAYOUT),
            PathStore(spark, f"{root}/quality", "json"),
            PathStore(spark, f"{root}/revisions", "json"),
        )

    @classmethod
    def in_catalog(cls, spark: SparkSession, *schema: str, fmt: str = "parquet") -> Warehouse:
        """Tables in a catalog schema."""

        def store(name: str) -> CatalogStore:
            return CatalogStore(spark, *schema, name, fmt=fmt)

        return cls(
            spark,
            ArtifactRegistry(store("artifacts")),
            BronzeTable(store("bronze_observations")),
            SnapshotTable(spark, store("current_observations"), CURRENT_TYPES, fmt),
            SnapshotTable(spark, store("silver_observations"), SILVER_TYPES, fmt),
            SnapshotTable(spark, store("gold_metrics"), GOLD_TYPES, fmt, **GOLD_LAYOUT),
            store("quality_reports"),
            store("revision_reports"),
        )


@dataclass(frozen=True)
class Release:
    """Where a release file lies and what is known about it beforehand."""

    path: str
    source_url: str
    dataset_year: int
    dataset_version: str
    schema_version: str = RAW_SCHEMA_VERSION


@dataclass(frozen=True)
class Ingestion:
    metadata: ArtifactMetadata
    duplicate: bool
    bronze_rows: DataFrame


def ingest(warehouse: Warehouse, release: Release, *, clock: Clock = utc_now) -> Ingestion:
    """Read and validate the file and register it once.

    The first registration of the same bytes wins, with its URL, year and time.
    """
    artifact = read_artifact(warehouse.spark, release.path)
    metadata, duplicate = warehouse.registry.register(
        ArtifactMetadata(
            ingestion_id=artifact.source_sha256,
            source_file=release.path,
            source_url=release.source_url,
            source_sha256=artifact.source_sha256,
            dataset_year=release.dataset_year,
            dataset_version=release.dataset_version,
            ingestion_timestamp=iso_instant(clock()),
            row_count=artifact.row_count,
            schema_version=release.schema_version,
        )
    )
    if metadata.row_count != artifact.row_count:
        raise IntegrityError("The artifact's row count differs from its registered metadata.")
    return Ingestion(metadata, duplicate, to_bronze(artifact.rows, metadata))


def store_bronze(warehouse: Warehouse, ingestion: Ingestion) -> AppendResult:
    return append_artifact(
        warehouse, ingestion.bronze_rows, ingestion.metadata.ingestion_id, ingestion.metadata.row_count
    )


def append_artifact(warehouse: Warehouse, rows: DataFrame, ingestion_id: str, expected_rows: int) -> AppendResult:
    """Append Bronze rows, and bring the current releases up to date where they were.

    Only the new artifact and the stored current releases are read for that.
    """
    before = bronze_fingerprint(warehouse)
    result = warehouse.bronze.append(rows, ingestion_id, expected_rows)
    if not result.duplicate and warehouse.current.is_current(before, SILVER_SCHEMA_VERSION):
        added = warehouse.bronze.read().where(F.col("ingestion_id") == ingestion_id)
        merged = merged_releases(warehouse.current.read(), added)
        warehouse.current.publish(merged, bronze_fingerprint(warehouse), SILVER_SCHEMA_VERSION)
    return result


def bronze_fingerprint(warehouse: Warehouse) -> str:
    """Identity of the stored artifacts, from their facts; only the digest comes back."""
    return silver_fingerprint(warehouse.bronze.artifacts()).first()["fingerprint"]


def stored_current_releases(warehouse: Warehouse) -> DataFrame:
    """The current releases of Bronze as a table, made anew if an append did not leave them."""
    fingerprint = bronze_fingerprint(warehouse)
    if not warehouse.current.is_current(fingerprint, SILVER_SCHEMA_VERSION):
        warehouse.current.publish(current_releases(warehouse.bronze.require()), fingerprint, SILVER_SCHEMA_VERSION)
    return warehouse.current.read()


def refresh_silver(warehouse: Warehouse, *, clock: Clock = utc_now) -> SnapshotResult:
    """Rebuild Silver from Bronze unless it already has this input's fingerprint.

    What decides about a row, its key's current release and its artifact's facts, is kept
    in tables; the history is read once.
    """
    history = warehouse.bronze.require()
    current = stored_current_releases(warehouse)
    selected = require_unambiguous(history, current)
    fingerprint = bronze_fingerprint(warehouse)
    if warehouse.silver.is_current(fingerprint, SILVER_SCHEMA_VERSION):
        return warehouse.silver.reuse(fingerprint, selected)
    silver = build_silver(
        history,
        fingerprint=fingerprint,
        processed_at=clock(),
        facts=warehouse.bronze.facts(),
        current=current,
    )
    return warehouse.silver.publish(silver, fingerprint, SILVER_SCHEMA_VERSION, selected, counts=silver_counts())


def refresh_gold(warehouse: Warehouse, *, clock: Clock = utc_now) -> SnapshotResult:
    """Rebuild Gold from Silver unless it already has this input's fingerprint.

    The records behind every metric are published with it, as the table ``lineage``.
    """
    silver = warehouse.silver.require("The Silver table")
    of_silver = warehouse.silver.pointer()["fingerprint"]
    fingerprint = gold_fingerprint_of([of_silver])
    if warehouse.gold.is_current(fingerprint, GOLD_SCHEMA_VERSION):
        return warehouse.gold.reuse(fingerprint)
    gold = build_gold(
        silver,
        fingerprint=fingerprint,
        processed_at=clock(),
        ranges=GOLD_LAYOUT["sort"],
        silver_fingerprint=of_silver,
    )
    return warehouse.gold.publish(
        gold, fingerprint, GOLD_SCHEMA_VERSION, arranged=True,
        counts=gold_counts(), beside={"lineage": lambda stored: gold_lineage(silver, stored, arranged=True)},
    )


def lineage_of(warehouse: Warehouse, metric_record_id: str) -> DataFrame:
    """All records behind one metric row: a filtered scan of the lineage published with Gold."""
    return warehouse.gold.read(table="lineage").where(F.col("metric_record_id") == metric_record_id)


def assess_quality(warehouse: Warehouse, *, clock: Clock = utc_now) -> dict:
    """Run the quality checks over stored Silver and append the report.

    Row totals and failed rules were counted when Silver was written. A report has one row per check; the summary repeats on each of its rows.
    """
    silver = warehouse.silver.require("The Silver table")
    checks = stage(quality_checks(silver, warehouse.bronze.read()), "quality-checks")
    pointer = warehouse.silver.pointer()
    counts = pointer["counts"]
    summary = quality_summary(silver, checks, (pointer["rows"], counts["valid"])).first().asDict()
    stamp = iso_instant(clock())
    columns = [F.lit(value).alias(name) for name, value in summary.items()]
    # Counted while Silver was written, like the rows.
    failed = {name.removeprefix("rule:"): n for name, n in counts.items() if n and name.startswith("rule:")}
    spread = F.lit(json.dumps(failed, sort_keys=True)).alias("failure_distribution")
    report = checks.select(F.lit(stamp).alias("generated_at"), "*", *columns, spread)
    warehouse.quality.write(report.coalesce(1), "append")
    return {"generated_at": stamp, **summary, "failure_distribution": failed}


@dataclass(frozen=True)
class LoadResult:
    bronze: AppendResult | None
    silver: SnapshotResult | None
    quality: dict | None
    gold: SnapshotResult | None


def run_initial_load(
    warehouse: Warehouse, release: Release, *, clock: Clock = utc_now
) -> LoadResult:
    """Bronze, Silver, quality report, Gold. A failed check is reported, not blocking."""
    ingestion = ingest(warehouse, release, clock=clock)
    if not warehouse.bronze.holds_only(ingestion.metadata.ingestion_id):
        raise SourceTableError("An initial load needs a Bronze table without other artifacts.")
    return LoadResult(
        store_bronze(warehouse, ingestion),
        refresh_silver(warehouse, clock=clock),
        assess_quality(warehouse, clock=clock),
        refresh_gold(warehouse, clock=clock),
    )


def plan_load(warehouse: Warehouse, ingestion: Ingestion) -> DataFrame:
    """What the artifact requires of each layer, from the stored state."""
    spark = warehouse.spark
    nothing = spark.createDataFrame([], "fingerprint STRING")
    no_artifacts = spark.createDataFrame([], "ingestion_id STRING, source_sha256 STRING")
    no_overlap = spark.sql(
        "SELECT 0L AS overlapping_observations, 0L AS changed_existing_observations"
    )
    stored = warehouse.bronze.exists()
    return incremental_plan(
        ingestion.metadata.ingestion_id,
        ingestion.metadata.source_sha256,
        artifacts=warehouse.bronze.artifacts() if stored else no_artifacts,
        silver_fingerprints=(
            warehouse.silver.fingerprints() if warehouse.silver.exists() else nothing
        ),
        gold_fingerprints=warehouse.gold.fingerprints() if warehouse.gold.exists() else nothing,
        # A stored artifact is not compared again: its rows are in the history already.
        overlap=(
            stage(overlap_and_change(ingestion.bronze_rows, warehouse.bronze.read()), "overlap")
            if stored and not warehouse.bronze.rows_of(ingestion.metadata.ingestion_id)
            else no_overlap
        ),
    )


@dataclass(frozen=True)
class IncrementalResult:
    plan: list[dict]
    loaded: LoadResult
    final_plan: list[dict]

    @property
    def status(self) -> str:
        return self.plan[0]["pipeline_status"]


def run_incremental(
    warehouse: Warehouse, release: Release, *, clock: Clock = utc_now
) -> IncrementalResult:
    """Rebuild only what the plan requires, then plan again to prove it is current."""
    ingestion = ingest(warehouse, release, clock=clock)

    def plan() -> list[dict]:
        return [row.asDict() for row in plan_load(warehouse, ingestion).collect()]

    first = plan()
    required = {row["layer"] for row in first if row["action"] == "REQUIRED"}
    if not required:
        return IncrementalResult(first, LoadResult(None, None, None, None), first)
    loaded = LoadResult(
        store_bronze(warehouse, ingestion) if "Bronze" in required else None,
        refresh_silver(warehouse, clock=clock) if "Silver" in required else None,
        None,
        refresh_gold(warehouse, clock=clock) if "Gold" in required else None,
    )
    return IncrementalResult(first, loaded, plan())


@dataclass(frozen=True)
class RevisionReport:
    revision_id: str
    overall_result: str
    precedence_rule: str
    previous_releases: list[dict]
    incoming_release: dict
    overlapping_observations: int
    unchanged_republications: int
    revised_values: int
    revised_metadata: int
    newly_added_observations: int
    observations_absent_from_incoming: int
    current_view_observations_changed: int
    value_transition_counts: dict[str, int]
    silver_rebuild_required: bool
    gold_rebuild_required: bool
    message: str

    @property
    def source_sha256(self) -> str:
        return self.incoming_release["source_sha256"]


# Fixed message texts per result.
MESSAGES = {
    "ELIGIBLE": "Incoming official release has a strictly greater dataset_year for every "
    "overlapping current observation.",
    "DEFERRED_AMBIGUOUS": "Release precedence is insufficient or this is not an overlapping "
    "revision.",
    "APPLIED": "Newer official release was preserved in Bronze and selected in the "
    "deterministic Silver current view; Gold was refreshed.",
    "NO_OP": "The artifact is already current or is not an overlapping revision.",
    "NOT_REVISION": "The artifact is already current or is not an overlapping revision.",
}
COUNTERS = (
    "overlapping_observations",
    "unchanged_republications",
    "revised_values",
    "revised_metadata",
    "newly_added_observations",
    "observations_absent_from_incoming",
    "current_view_observations_changed",
)


def _report(result: str, metadata: ArtifactMetadata, previous, counts, transitions):
    eligible = result == "ELIGIBLE"
    identity = f"{metadata.dataset_year}|{metadata.dataset_version}|{metadata.source_sha256}"
    return RevisionReport(
        revision_id=revision_id_of(
            [release["source_sha256"] for release in previous], metadata.source_sha256
        ),
        overall_result=result,
        precedence_rule=PRECEDENCE_RULE,
        previous_releases=previous,
        incoming_release={"release_identity": identity, **metadata.to_dict()},
        **{name: int(counts.get(name, 0)) for name in COUNTERS},
        value_transition_counts=dict(sorted(transitions.items())),
        silver_rebuild_required=eligible,
        gold_rebuild_required=eligible,
        message=MESSAGES[result],
    )


def analyze_revision(
    candidate: DataFrame, history: DataFrame, metadata: ArtifactMetadata
) -> RevisionReport:
    """Revision report of a candidate against history without it."""
    require_unambiguous(history)
    # Read three times below, so the key-level comparison is written once.
    pairs = observation_pairs(candidate, history).staged()
    counts = revision_counts(pairs).first().asDict()
    if counts["duplicated_keys"]:
        raise DuplicateKeyError(
            f"{counts['duplicated_keys']} observation key(s) have several differing rows."
        )
    previous = [
        {
            **{k: v for k, v in row.asDict().items() if k != "overlapping_observations"},
            "ingestion_timestamp": str(row.ingestion_timestamp),
        }
        for row in previous_releases(pairs, metadata.dataset_year).collect()
    ]
    newer = all(release.pop("superseded") for release in previous)
    transitions = {row.transition: row.observations for row in stage(value_transitions(pairs), "transitions").collect()}
    if not counts["overlapping_observations"]:
        result = "NOT_REVISION"
    else:
        result = "ELIGIBLE" if newer else "DEFERRED_AMBIGUOUS"
    return _report(result, metadata, previous, counts, transitions)


@dataclass(frozen=True)
class RevisionResult:
    report: RevisionReport
    duplicate: bool
    loaded: LoadResult


def run_revision(warehouse: Warehouse, release: Release, *, clock: Clock = utc_now) -> RevisionResult:
    """Classify a release against the current view and apply it when it is newer.

    A stored report of the same bytes ends the run. A release that overlaps nothing is
    not a revision and leaves no report, so the incremental load can still take it.
    """
    nothing = LoadResult(None, None, None, None)
    ingestion = ingest(warehouse, release, clock=clock)
    metadata = ingestion.metadata
    known = read_revision_report(warehouse, metadata.source_sha256)
    if known is not None:
        return RevisionResult(known, True, nothing)
    if not warehouse.bronze.exists():
        return RevisionResult(_report("NOT_REVISION", metadata, [], {}, {}), False, nothing)
    history = warehouse.bronze.read().where(F.col("ingestion_id") != metadata.ingestion_id)
    if history.isEmpty():
        return RevisionResult(_report("NO_OP", metadata, [], {}, {}), False, nothing)
    report = analyze_revision(ingestion.bronze_rows, history, metadata)
    if report.overall_result == "NOT_REVISION":
        return RevisionResult(report, False, nothing)
    if report.overall_result != "ELIGIBLE":
        _write_revision_report(warehouse, report)
        return RevisionResult(report, False, nothing)
    loaded = LoadResult(
        store_bronze(warehouse, ingestion),
        refresh_silver(warehouse, clock=clock),
        None,
        refresh_gold(warehouse, clock=clock),
    )
    applied = replace(report, overall_result="APPLIED", message=MESSAGES["APPLIED"])
    _write_revision_report(warehouse, applied)
    return RevisionResult(applied, False, loaded)


def _write_revision_report(warehouse: Warehouse, report: RevisionReport) -> None:
    row = warehouse.spark.createDataFrame(
        [(report.source_sha256, json.dumps(asdict(report), sort_keys=True))],
        "source_sha256 STRING, report STRING",
    )
    warehouse.revisions.write(row.coalesce(1), "append", partitionBy="source_sha256")


def read_revision_report(warehouse: Warehouse, source_sha256: str) -> RevisionReport | None:
    """The stored report of an artifact; reads only its partition."""
    if not warehouse.revisions.exists():
        return None
    found = (
        warehouse.revisions.read("report STRING, source_sha256 STRING")
        .where(F.col("source_sha256") == source_sha256)
        .first()
    )
    return None if found is None else RevisionReport(**json.loads(found["report"]))
