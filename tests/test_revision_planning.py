from __future__ import annotations

import pytest
from conftest import SHA_A, SHA_B, SHA_C

from tallymark.functions.hashing import gold_fingerprint_of, silver_fingerprint_of
from tallymark.operators.audit import lineage_audit
from tallymark.operators.bronze import ArtifactMetadata, to_bronze
from tallymark.operators.planning import incremental_plan
from tallymark.operators.revision import (
    observation_pairs,
    overlap_and_change,
    previous_releases,
    revision_counts,
    value_transitions,
)
from tallymark.operators.silver import to_silver


def rows(artifact, released, values, **more):
    return [
        {"ingestion_id": artifact, "source_sha256": artifact, "dataset_year": released,
         "dataset_version": f"v{released}", "Industry_code_NZSIOC": code, "Value": value,
         **(more.get(code, {}))}
        for code, value in values.items()
    ]


OLD = {"A": "1", "B": "2", "C": "3", "D": "C", "E": "5", "F": "S", "G": "7", "H": "8"}
NEW = {"A": "1", "B": "20", "C": "C", "D": "4", "E": "S", "F": "6", "G": "7", "I": "9"}


@pytest.fixture(scope="module")
def two_releases(bronze):
    renamed = {"G": {"Industry_name_NZSIOC": "Renamed"}}
    return bronze(rows(SHA_B, 2026, NEW, **renamed)), bronze(rows(SHA_A, 2025, OLD))


def test_revision_counts(two_releases):
    pairs = observation_pairs(*two_releases)
    counts = revision_counts(pairs).first().asDict()
    assert counts == {
        "overlapping_observations": 7,
        "unchanged_republications": 1,
        "revised_values": 5,
        "revised_metadata": 1,
        "newly_added_observations": 1,
        "observations_absent_from_incoming": 1,
        "current_view_observations_changed": 7,
        "duplicated_keys": 0,
    }
    moves = {r.transition: r.observations for r in value_transitions(pairs).collect()}
    assert moves == {
        "PUBLISHED->PUBLISHED": 1,
        "PUBLISHED->CONFIDENTIAL": 1,
        "CONFIDENTIAL->PUBLISHED": 1,
        "PUBLISHED->SUPPRESSED": 1,
        "SUPPRESSED->PUBLISHED": 1,
    }
    previous = previous_releases(pairs, 2026).collect()
    assert [(r.release_identity, r.superseded) for r in previous] == [(f"2025|v2025|{SHA_A}", True)]
    assert not previous_releases(pairs, 2025).first().superseded


def test_current_side_is_the_newest_release(bronze):
    history = bronze(rows(SHA_A, 2024, {"A": "1", "B": "1"}) + rows(SHA_C, 2025, {"A": "2"}))
    candidate = bronze(rows(SHA_B, 2026, {"A": "2", "B": None}))
    counts = revision_counts(observation_pairs(candidate, history)).first()
    # A equals the 2025 release; B moved from text to null, which is a revision.
    assert (counts.unchanged_republications, counts.revised_values) == (1, 1)
    moves = value_transitions(observation_pairs(candidate, history)).collect()
    assert [m.transition for m in moves] == ["PUBLISHED->OTHER"]


def test_repeated_keys_are_reported_not_multiplied(bronze):
    candidate = bronze(rows(SHA_B, 2026, {"A": "1"}) + rows(SHA_B, 2026, {"A": "2"}))
    history = bronze(rows(SHA_A, 2025, {"A": "1"}))
    counts = revision_counts(observation_pairs(candidate, history)).first()
    assert (counts.overlapping_observations, counts.duplicated_keys) == (1, 1)
    copies = bronze(rows(SHA_B, 2026, {"A": "1"}) + rows(SHA_B, 2026, {"A": "1"}))
    assert revision_counts(observation_pairs(copies, history)).first().duplicated_keys == 0


def test_history_is_reduced_to_digests(two_releases):
    """No texts of the history are sorted or shuffled where only counters are asked for."""
    counts = revision_counts(observation_pairs(*two_releases))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any("Value" in line or "Industry" in line for line in exchanged)


def test_overlap_and_change(two_releases):
    found = overlap_and_change(*two_releases).first()
    assert tuple(found) == (7, 6)
    assert tuple(overlap_and_change(two_releases[0], two_releases[0]).first()) == (8, 0)


def plan(spark, candidate, stored, silver, gold, overlap=(0, 0)):
    frame = incremental_plan(
        candidate,
        candidate,
        artifacts=spark.createDataFrame([(s, s) for s in stored], "ingestion_id STRING, source_sha256 STRING"),
        silver_fingerprints=spark.createDataFrame([(s,) for s in silver], "fingerprint STRING"),
        gold_fingerprints=spark.createDataFrame([(g,) for g in gold], "fingerprint STRING"),
        overlap=spark.createDataFrame(
            [overlap], "overlapping_observations BIGINT, changed_existing_observations BIGINT"),
    )
    found = frame.collect()
    return found, found[0].pipeline_status, [r.action for r in found]


A_PRINT = silver_fingerprint_of([(SHA_A, SHA_A)])
A_GOLD = gold_fingerprint_of([A_PRINT])


def test_plans(spark):
    assert plan(spark, SHA_A, [SHA_A], [A_PRINT], [A_GOLD])[1:] == ("NO_OP", ["CURRENT"] * 3)
    assert plan(spark, SHA_B, [SHA_A], [A_PRINT], [A_GOLD])[1:] == ("PROCESS_REQUIRED", ["REQUIRED"] * 3)
    assert plan(spark, SHA_A, [], [], [])[1:] == ("PROCESS_REQUIRED", ["REQUIRED"] * 3)
    assert plan(spark, SHA_A, [SHA_A], ["x"], [A_GOLD])[2] == ["CURRENT", "REQUIRED", "REQUIRED"]
    assert plan(spark, SHA_A, [SHA_A], [A_PRINT, "x"], [A_GOLD])[2] == ["CURRENT", "REQUIRED", "REQUIRED"]
    assert plan(spark, SHA_A, [SHA_A], [A_PRINT], ["x"])[2] == ["CURRENT", "CURRENT", "REQUIRED"]


def test_overlap_defers_everything_unless_already_stored(spark):
    found, status, actions = plan(spark, SHA_B, [SHA_A], [A_PRINT], [A_GOLD], (2, 0))
    assert (status, actions) == ("DEFERRED_REVISION", ["DEFERRED"] * 3)
    assert (found[0].overlap_observations, found[0].current_identities, found[0].expected_identity) == (2, [], None)
    found, status, _ = plan(spark, SHA_A, [SHA_A], [A_PRINT], [A_GOLD], (2, 1))
    assert (status, found[0].overlap_observations) == ("NO_OP", 0)
    assert found[1].expected_identity == A_PRINT and found[2].expected_identity == A_GOLD
    assert found[0].artifact_status == "ALREADY_PROCESSED"


def test_lineage_audit(bronze):
    from conftest import NOW

    stored = bronze([{"Year": "2024"}, {"Year": "2025"}])
    silver = to_silver(stored, fingerprint="F", processed_at=NOW)
    assert lineage_audit(silver, stored).first().rows == 0
    assert lineage_audit(silver, stored.where("Year = '2024'")).first().rows == 1
    other = stored.selectExpr("*").withColumn("Value", stored["Value"].substr(1, 1))
    assert lineage_audit(silver, other).first().rows == 2


def test_bronze_rows_carry_metadata(bronze, spark):
    raw = bronze([{}]).select("Year", *bronze([{}]).columns[1:10], "source_row_number")
    metadata = ArtifactMetadata(
        SHA_A, "f", "u", SHA_A, 2025, "v", "2026-09-23T13:02:03+12:00", 1)
    row = to_bronze(raw, metadata).selectExpr("*", "CAST(ingestion_timestamp AS STRING) AS t").first()
    assert (row.ingestion_id, row.row_count, row.t) == (SHA_A, 1, "2026-09-23 01:02:03")
