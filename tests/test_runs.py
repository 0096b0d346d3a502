from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import NOW
from test_ingest import line, write

from tallymark.errors import IntegrityError, SourceTableError
from tallymark.plans import runs
from tallymark.plans.runs import Release, Warehouse


def clock():
    return NOW


def release(path, year, url="https://example.org/x.csv"):
    return Release(path, url, year, f"{year}-financial-year-provisional")


def data(path, years, name="Agriculture", value="1"):
    return write(path, *[line(str(year), value, name) for year in years])


def test_incremental_life_cycle(spark, tmp_path):
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    first = release(data(tmp_path / "a.csv", [2023, 2024]), 2024)
    run = runs.run_incremental(warehouse, first, clock=clock)
    assert run.status == "PROCESS_REQUIRED"
    assert run.final_plan[0]["pipeline_status"] == "NO_OP"
    assert (run.loaded.bronze.inserted_rows, run.loaded.silver.rows, run.loaded.gold.rows) == (2, 2, 12)

    again = runs.run_incremental(warehouse, first, clock=clock)
    assert again.status == "NO_OP" and again.loaded.bronze is None
    assert warehouse.silver.history().count() == warehouse.gold.history().count() == 1
    direct = runs.refresh_silver(warehouse, clock=clock)
    assert direct.duplicate and warehouse.silver.history().count() == 1

    second = release(data(tmp_path / "b.csv", [2025]), 2025)
    run = runs.run_incremental(warehouse, second, clock=clock)
    assert (run.loaded.bronze.total_rows, run.loaded.silver.rows, run.loaded.gold.rows) == (3, 3, 18)
    assert warehouse.silver.history().count() == 2

    revised = release(data(tmp_path / "c.csv", [2023], value="9"), 2025)
    deferred = runs.run_incremental(warehouse, revised, clock=clock)
    assert deferred.status == "DEFERRED_REVISION"
    assert deferred.plan[0]["overlap_observations"] == deferred.plan[0]["changed_existing_observations"] == 1
    assert warehouse.bronze.read().count() == 3

    # The stored pointer names the current snapshot; a lost row is noticed.
    report = runs.assess_quality(warehouse, clock=clock)
    assert (report["overall_result"], report["rows_accepted"]) == ("PASS", 3)
    assert warehouse.quality.read().count() == 16


def test_revision_life_cycle(spark, tmp_path):
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    old = release(data(tmp_path / "a.csv", [2022, 2023, 2024]), 2024)
    assert runs.run_revision(warehouse, old, clock=clock).report.overall_result == "NOT_REVISION"
    runs.run_initial_load(warehouse, old, clock=clock)
    assert runs.run_revision(warehouse, old, clock=clock).report.overall_result == "NO_OP"

    # Only two of three observations are republished: a partial revision.
    newer = release(data(tmp_path / "b.csv", [2023, 2024], value="5"), 2025)
    result = runs.run_revision(warehouse, newer, clock=clock)
    report = result.report
    assert (report.overall_result, report.overlapping_observations, report.revised_values) == ("APPLIED", 2, 2)
    assert report.observations_absent_from_incoming == 1
    assert report.value_transition_counts == {"PUBLISHED->PUBLISHED": 2}
    assert (result.loaded.bronze.total_rows, result.loaded.silver.rows) == (5, 3)
    silver = warehouse.silver.read().collect()
    assert sorted((r.year, r.value_raw, r.is_valid) for r in silver) == [
        (2022, "1", True), (2023, "5", True), (2024, "5", True)]

    repeat = runs.run_revision(warehouse, newer, clock=clock)
    assert repeat.duplicate and repeat.report == report
    assert warehouse.revisions.read().count() == 1

    tied = release(data(tmp_path / "c.csv", [2024], value="6"), 2025)
    assert runs.run_revision(warehouse, tied, clock=clock).report.overall_result == "DEFERRED_AMBIGUOUS"
    additive = release(data(tmp_path / "d.csv", [2030]), 2030)
    assert runs.run_revision(warehouse, additive, clock=clock).report.overall_result == "NOT_REVISION"
    assert warehouse.revisions.read().count() == 2
    assert warehouse.bronze.read().count() == 5


def test_initial_load_guard_and_registry(spark, tmp_path):
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    first = release(data(tmp_path / "a.csv", [2023]), 2024)
    runs.run_initial_load(warehouse, first, clock=clock)
    repeated = runs.run_initial_load(warehouse, first, clock=clock)
    assert repeated.bronze.duplicate and repeated.silver.duplicate and repeated.gold.duplicate
    renamed = runs.ingest(warehouse, replace(first, dataset_year=2030, source_url="u"), clock=clock)
    assert renamed.duplicate
    assert (renamed.metadata.dataset_year, renamed.metadata.source_url) == (2024, first.source_url)
    with pytest.raises(SourceTableError):
        runs.run_initial_load(warehouse, release(data(tmp_path / "b.csv", [2025]), 2025), clock=clock)
    rows = warehouse.bronze.read()
    with pytest.raises(IntegrityError):
        warehouse.bronze.append(rows, renamed.metadata.ingestion_id, 7)
    with pytest.raises(SourceTableError):
        runs.refresh_silver(Warehouse.at(spark, str(tmp_path / "none")))


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tm LOCATION '{tmp_path}/tm'")
    warehouse = Warehouse.in_catalog(spark, "tm")
    first = release(data(tmp_path / "a.csv", [2023, 2024]), 2024)
    loaded = runs.run_initial_load(warehouse, first, clock=clock)
    assert (loaded.silver.rows, loaded.gold.rows, loaded.quality["overall_result"]) == (2, 12, "PASS")
    assert runs.run_incremental(warehouse, first, clock=clock).status == "NO_OP"


def test_a_retried_snapshot_is_made_once(spark, monkeypatch):
    """Two attempts write the same stored Silver; neither joins and checks the history again."""
    import __spark_entry__ as registry

    staged, made = [], registry.stage
    monkeypatch.setattr(registry, "stage", lambda frame, name, **options: staged.append(name) or made(frame, name, **options))
    steps = registry.catalog_retry(spark, "/root/testdata/sf0.001").orderBy("step").collect()
    assert staged == ["bronze", "silver"]
    assert [r.duplicate for r in steps] == [False, False, True, False, False, True]
    assert steps[3].visible == 0 and steps[4].visible == steps[5].visible > 0
