"""What is kept beside the tables, and that it saves the scans it is kept for."""

from __future__ import annotations

import time

import pytest
from conftest import NOW, SHA_A, SHA_B, SHA_C
from pyspark.sql import functions as F

from tallymark.errors import IntegrityError
from tallymark.operators.current_view import current_releases, require_unambiguous
from tallymark.operators.gold import gold_lineage
from tallymark.operators.silver import artifact_facts, build_silver
from tallymark.plans import runs
from tallymark.plans.runs import Warehouse
from tallymark.session import stage
from tallymark.sources import tables
from tallymark.sources.tables import PathStore, SnapshotTable


def clock():
    return NOW


def artifact(bronze, sha, released, years, code="AA", value="1"):
    rows = [
        {"Year": str(y), "Industry_code_NZSIOC": code, "Value": value, "ingestion_id": sha, "source_sha256": sha, "dataset_year": released}
        for y in years
    ]
    return bronze(rows), sha, len(rows)


def test_refresh_reads_the_history_once_and_equals_a_rebuild(spark, bronze, tmp_path, monkeypatch):
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    built = []

    def seen(*args, **options):
        built.append(build_silver(*args, **options))
        return built[-1]

    monkeypatch.setattr(runs, "build_silver", seen)
    for rows in (artifact(bronze, SHA_A, 2024, range(2000, 2010)), artifact(bronze, SHA_B, 2025, range(2005, 2012), value="2"),
                 artifact(bronze, SHA_C, 2025, [2020, 2020], code="BB")):
        runs.append_artifact(warehouse, *rows)
        runs.refresh_silver(warehouse, clock=clock)
    history = warehouse.bronze.read()
    # Merged at each append, not made anew.
    assert warehouse.current.history().count() == 3
    assert sorted(map(tuple, warehouse.current.read().collect())) == sorted(map(tuple, current_releases(history).select(*warehouse.current.types).collect()))
    again = build_silver(history, fingerprint=warehouse.silver.pointer()["fingerprint"], processed_at=NOW)
    assert sorted(map(str, warehouse.silver.read().collect())) == sorted(map(str, again.collect()))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = built[-1]._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("/w/bronze]") == 1 and "/w/current" in plan and "/w/bronze_facts]" in plan


def test_planning_a_known_artifact_reads_no_data_file(spark, bronze, tmp_path, monkeypatch):
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    rows, sha, count = artifact(bronze, SHA_A, 2024, range(3))
    runs.append_artifact(warehouse, rows, sha, count)
    runs.refresh_silver(warehouse, clock=clock)
    runs.refresh_gold(warehouse, clock=clock)
    metadata = runs.ArtifactMetadata(sha, "f", "u", sha, 2024, "v", "2026-01-01T00:00:00Z", count)

    def refuse(*_):
        raise AssertionError("a data file is read")

    monkeypatch.setattr(warehouse.bronze, "read", refuse)
    monkeypatch.setattr(warehouse.silver, "read", refuse)
    monkeypatch.setattr(warehouse.gold, "read", refuse)
    plan = runs.plan_load(warehouse, runs.Ingestion(metadata, True, rows))
    read = plan.inputFiles()
    assert read and all("/bronze_facts/" in path for path in read)
    assert {r.pipeline_status for r in plan.collect()} == {"NO_OP"}


def test_artifact_facts(spark, bronze):
    rows = [{"ingestion_id": SHA_A, "source_row_number": n} for n in (1, 2, 70_000, -1, 0)]
    rows += [{"ingestion_id": SHA_B, "source_row_number": n, "source_sha256": s} for n, s in ((5, SHA_B), (5, SHA_C))]
    rows += [{"ingestion_id": SHA_C, "source_row_number": n} for n in (None, None, 1)]
    found = {(r.ingestion_id, r.source_sha256): (r.artifact_rows, r.repeated_numbers) for r in artifact_facts(bronze(rows)).collect()}
    assert {k[0]: v[1] for k, v in found.items()} == {SHA_A: False, SHA_B: True, SHA_C: True}
    assert found[SHA_B, SHA_B] == found[SHA_B, SHA_C] == (1, True)
    assert artifact_facts(bronze([{}]).limit(0)).count() == 0


def test_rows_of_a_failed_append_are_not_read(spark, bronze, tmp_path, monkeypatch):
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    rows, sha, count = artifact(bronze, SHA_A, 2024, range(4))
    with pytest.raises(IntegrityError):
        warehouse.bronze.append(rows, sha, count + 1)
    assert warehouse.bronze.read().count() == 0 and not warehouse.bronze.rows_of(sha)
    assert warehouse.bronze.append(rows, sha, count).inserted_rows == 4
    assert warehouse.bronze.read().count() == 4
    # A table without facts, from before they were kept, gets them from one scan.
    old = tables.BronzeTable(PathStore(spark, str(tmp_path / "old")))
    old.store.write_attempt(rows, "ingestion_id")
    assert old.rows_of(sha) == 4 and old.read().count() == 4


def test_counts_come_with_the_write(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), {"id": "bigint", "part": "string"}, partition="part", sort=("id",))
    rows = spark.range(1_000).selectExpr("id", "if(id % 10 = 0, 'few', 'most') AS part")
    result = table.publish(rows, "F", "v", counts={"odd": F.count_if(F.col("id") % 2 == 1)})
    assert (result.rows, result.counts) == (1_000, {"odd": 500})
    assert table.publish(rows, "F", "v").counts == {"odd": 500}
    with pytest.raises(IntegrityError):
        table.publish(rows, "G", "v", 7)
    assert table.read().count() == 1_000 and table.fingerprints().first()[0] == "F"


def test_publish_splits_a_hot_level_evenly(spark, tmp_path):
    """Four of five rows are of one metric and level; no task writes much more than another."""
    table = SnapshotTable(spark, str(tmp_path / "t"), {"metric_id": "string", "level": "string", "code": "bigint"},
                          partition="metric_id", sort=("level", "code"))
    rows = spark.range(40_000, numPartitions=4).selectExpr(
        "if(id % 10 < 9, 'M4', 'M1') AS metric_id", "if(id % 9 < 8, 'Level 4', 'Level 1') AS level", "id AS code")
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "16"), spark.conf.set(adaptive, "false")
    try:
        table.publish(rows, "F", "v")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4"), spark.conf.set(adaptive, "true")
    name = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)
    per_task = [r["count"] for r in table.read().groupBy(name.alias("task")).count().orderBy("count").collect()]
    assert len(per_task) == 16 and per_task[-1] <= 2 * per_task[len(per_task) // 2]
    plan = table.read().where("metric_id = 'M4' AND code = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric_id" in plan and "EqualTo(code,5)" in plan


def test_lineage_is_published_with_gold(spark, bronze, tmp_path):
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    twice = artifact(bronze, SHA_A, 2024, [2020, 2020, 2020, 2021])
    runs.append_artifact(warehouse, *twice)
    runs.refresh_silver(warehouse, clock=clock)
    result = runs.refresh_gold(warehouse, clock=clock)
    assert result.counts["status:INVALID_DUPLICATE"] == 1
    metrics = warehouse.gold.read().collect()
    repeated = next(r for r in metrics if r.metric_status == "INVALID_DUPLICATE")
    assert (repeated.year, repeated.source_silver_record_ids) == (2020, [])
    found = runs.lineage_of(warehouse, repeated.metric_record_id)
    assert sorted((r.role, r.record_id) for r in found.collect()) == [("current", f"{SHA_A}:{n}") for n in (1, 2, 3)]
    changed = next(r for r in metrics if r.year == 2021 and r.current_input_status == "PUBLISHED" and r.metric_type == "DERIVED")
    change = runs.lineage_of(warehouse, changed.metric_record_id).collect()
    assert sorted(r.role for r in change) == ["current", "prior", "prior", "prior"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_catalog_layout(spark, bronze, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS tm2 LOCATION '{tmp_path}/tm2'")
    warehouse = Warehouse.in_catalog(spark, "tm2")
    rows, sha, count = artifact(bronze, SHA_A, 2024, range(2020, 2023))
    warehouse.bronze.store.write_attempt(rows, "ingestion_id")
    assert warehouse.bronze.append(rows, sha, count).inserted_rows == 3
    assert warehouse.bronze.append(rows, sha, count).duplicate and warehouse.bronze.read().count() == 3
    runs.refresh_silver(warehouse, clock=clock)
    runs.refresh_gold(warehouse, clock=clock)
    with pytest.raises(IntegrityError):
        warehouse.gold.publish(warehouse.gold.read(), "G", "v", 1, beside={"lineage": lambda g: g.selectExpr("metric_record_id", "1 AS x")})
    assert warehouse.gold.read().count() == 18 and warehouse.gold.read(table="lineage").count() > 0


def test_arranged_rows_are_written_as_they_come(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, str(tmp_path / "t"), {"id": "bigint", "part": "string"}, partition="part", sort=("id",))
    rows = spark.range(100, numPartitions=3).selectExpr("id", "if(id % 10 = 0, 'few', 'most') AS part")
    monkeypatch.setattr(tables, "laid_out", lambda *_: pytest.fail("rows are brought into order again"))
    assert table.publish(rows.sortWithinPartitions("part", "id"), "F", "v", arranged=True).rows == 100
    assert sorted(r.id for r in table.read().where("part = 'few'").collect()) == list(range(0, 100, 10))


def test_published_lineage_shuffles_no_digests(spark, bronze, tmp_path):
    """Ids are made from what names a row after it was dealt out; digests are stored with zstd."""
    warehouse = Warehouse.at(spark, str(tmp_path / "w"))
    runs.append_artifact(warehouse, *artifact(bronze, SHA_A, 2024, [2020, 2020, 2021, 2022, 2024]))
    runs.refresh_silver(warehouse, clock=clock)
    runs.refresh_gold(warehouse, clock=clock)
    silver, gold = warehouse.silver.read(), warehouse.gold.read()
    made = gold_lineage(silver, gold, arranged=True)
    assert "metric_record_id:" not in made._jdf.queryExecution().executedPlan().toString(), "read from Gold"
    wanted = sorted(map(tuple, gold_lineage(silver, gold).collect()))
    assert {r[0] for r in wanted} <= {r.metric_record_id for r in gold.collect()} and len(wanted) == 13
    assert sorted(map(tuple, warehouse.gold.read(table="lineage").collect())) == wanted
    by_file = made.select("metric_record_id", F.spark_partition_id().alias("part")).collect()
    assert [r[0] for r in sorted(by_file, key=lambda r: r.part)] == [r[0] for r in wanted]
    files = [str(f) for name in ("silver", "gold") for f in (tmp_path / "w" / name).rglob("*.parquet")]
    assert files and all(".zstd." in f for f in files)


def shuffles(spark, *, but=(), wait=0):
    """Ids of the shuffles on disk but for some; their files may go a moment after their query."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    blocks = disk.getAllBlocks().mkString(" ").split()
    found = {block.split("_")[1] for block in blocks if block.startswith("shuffle_")} - set(but)
    if not found or not wait:
        return found
    time.sleep(0.2)
    return shuffles(spark, but=but, wait=wait - 1)


def test_writes_leave_no_shuffles_behind(spark, tmp_path):
    """What a write shuffled goes with its end, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(spark), spark.conf.get(name)
    rows = spark.range(1_000).groupBy((F.col("id") % 7).alias("id")).agg(F.lit("p").alias("part"))
    table = SnapshotTable(spark, str(tmp_path / "t"), {"id": "bigint", "part": "string"}, partition="part", sort=("id",), beside={"also": ("id",)})
    staged = stage(rows, "grouped")
    PathStore(spark, str(tmp_path / "p")).write(rows, "append")
    assert not shuffles(spark, but=before, wait=20) and staged.select("id").distinct().count() == 7
    before = shuffles(spark)
    assert table.publish(rows, "F", "v", beside={"also": lambda stored: stored.join(rows, ["id", "part"])}).rows == 7
    # Of a publication only the count of its rows is left.
    assert len(shuffles(spark, but=before, wait=20)) <= 1 and spark.conf.get(name) == setting
    assert table.read(table="also").count() == 7


def test_small_results_free_what_they_shuffled(spark, bronze):
    """A history is shuffled to be judged; of that nothing stays on disk."""
    rows = stage(artifact(bronze, SHA_A, 2024, [2020, 2020, 2021])[0], "history")
    before = shuffles(spark)
    assert require_unambiguous(rows) == 3
    assert not shuffles(spark, but=before, wait=20)
