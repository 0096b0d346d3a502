from __future__ import annotations

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from conftest import INCOME, NOW, RETURN, SHA_A, SURPLUS

from tallymark.contracts import GOLD_TYPES
from tallymark.errors import SchemaContractError
from tallymark.functions.skew import attach_group_facts
from tallymark.operators.audit import audit_gold, mixed_definitions
from tallymark.operators.current_view import select_current
from tallymark.operators.gold import (
    build_gold,
    gold_lineage,
    level_counts,
    metric_lineage,
    metric_status_counts,
)
from tallymark.operators.silver import to_silver
from tallymark.session import stage


@pytest.fixture(scope="module")
def gold_of(bronze):
    def build(rows, **options):
        silver = stage(to_silver(bronze(rows), fingerprint="F", processed_at=NOW), "silver")
        return build_gold(silver, fingerprint="G", processed_at=NOW, **options)

    return build


def values(gold):
    return {
        (r.industry_code_nzsioc, r.year, r.metric_id): r for r in gold.collect()
    }


def cell(code, year, value, kind=INCOME, level="Level 1", **more):
    return {
        **kind, "Industry_code_NZSIOC": code, "Year": str(year), "Value": value,
        "Industry_aggregation_NZSIOC": level, "Industry_name_NZSIOC": f"Name {code}", **more,
    }


def test_published_examples(gold_of):
    gold = values(
        gold_of(
            [
                cell("CC", 2024, "127,567"), cell("CC", 2025, "134,105"),
                cell("EE", 2024, "8216", SURPLUS), cell("EE", 2025, "6410", SURPLUS),
                cell("EE", 2024, "12", RETURN), cell("EE", 2025, "9", RETURN),
                cell("CC521", 2022, "10", SURPLUS, "Level 4"),
                cell("CC521", 2023, "C", SURPLUS, "Level 4"),
            ]
        )
    )
    assert gold["CC", 2025, "M1"].metric_value == Decimal(134105)
    assert round(gold["CC", 2025, "M4"].metric_value, 2) == Decimal("5.13")
    assert gold["EE", 2025, "M2"].metric_value == 6410
    assert gold["EE", 2025, "M5"].metric_value == -1806
    assert gold["EE", 2025, "M6"].metric_value == -3
    assert gold["CC521", 2023, "M2"].metric_status == "CONFIDENTIAL"
    change = gold["CC521", 2023, "M5"]
    assert (change.metric_status, change.metric_value) == ("UNAVAILABLE_INPUT", None)
    assert (change.current_input_status, change.prior_input_status) == ("CONFIDENTIAL", "PUBLISHED")
    assert change.source_silver_record_ids == [f"{SHA_A}:8", f"{SHA_A}:7"]
    first = gold["CC", 2024, "M4"]
    assert (first.metric_status, first.prior_input_status) == ("UNAVAILABLE_INPUT", "UNAVAILABLE")
    assert first.prior_input_record_ids == []
    assert gold["CC", 2025, "M2"].metric_status == "UNAVAILABLE"
    assert gold["CC", 2025, "M2"].source_silver_record_ids == []
    assert len(gold) == 6 * 6


def test_statuses(gold_of):
    gold = values(
        gold_of(
            [
                cell("ZERO", 2024, "0"), cell("ZERO", 2025, "5"),
                cell("NEG", 2024, "-10"), cell("NEG", 2025, "5"),
                cell("GAP", 2023, "1"), cell("GAP", 2025, "2"),
                cell("DUP", 2025, "1"), cell("DUP", 2025, "1"),
                cell("BAD", 2025, "bad"), cell("BLANK", 2025, " "),
                cell("SUPP", 2025, "S"), cell("META", 2025, "1", Units="Percentage"),
            ]
        )
    )
    status = {(code, metric): row.metric_status for (code, year, metric), row in gold.items() if year == 2025}
    assert status["ZERO", "M4"] == status["NEG", "M4"] == "NOT_MEANINGFUL_BASE"
    assert gold["ZERO", 2025, "M4"].metric_value is None
    assert status["GAP", "M4"] == "UNAVAILABLE_INPUT"
    assert status["DUP", "M1"] == "INVALID_DUPLICATE"
    assert status["BAD", "M1"] == "INVALID_VALUE"
    assert status["BLANK", "M1"] == "UNAVAILABLE"
    assert status["SUPP", "M1"] == "SUPPRESSED"
    assert status["META", "M1"] == "INVALID_VALUE"
    assert all((r.metric_value is not None) == (r.metric_status == "PUBLISHED") for r in gold.values())


def test_lineage_of_repeated_records(gold_of, bronze):
    """A row per record behind each metric, of one year and the next; none in the metric row."""
    rows = [cell("DUP", 2025, "1") for _ in range(4)] + [cell("DUP", 2026, "3"), cell("ONE", 2025, "1")]
    every = [f"{SHA_A}:{n}" for n in range(1, 5)]
    gold = gold_of(rows)
    by_key = values(gold)
    repeated, one = by_key["DUP", 2025, "M1"], by_key["ONE", 2025, "M1"]
    assert (repeated.source_silver_record_ids, repeated.metric_status) == ([], "INVALID_DUPLICATE")
    assert one.source_silver_record_ids == [f"{SHA_A}:6"]
    silver = to_silver(bronze(rows), fingerprint="F", processed_at=NOW)
    assert sorted(r.record_id for r in metric_lineage(silver).where("year = 2025 AND industry_code_nzsioc = 'DUP'").collect()) == every
    listed = {}
    for r in gold_lineage(silver, gold).collect():
        listed.setdefault((r.metric_record_id, r.role), []).append(r.record_id)
    assert sorted(listed[repeated.metric_record_id, "current"]) == every
    assert sorted(listed[by_key["DUP", 2026, "M4"].metric_record_id, "prior"]) == every
    assert listed[by_key["DUP", 2026, "M4"].metric_record_id, "current"] == [f"{SHA_A}:5"]
    assert (one.metric_record_id, "prior") not in listed


def test_mixed_rename_takes_all_values_away(gold_of, bronze):
    rows = [
        cell("AA", 2025, "1"),
        cell("AA", 2025, "2", SURPLUS, Industry_name_NZSIOC="Other name"),
    ]
    gold = values(gold_of(rows))
    assert {gold["AA", 2025, m].metric_status for m in ("M1", "M2", "M3")} == {"INVALID_VALUE"}
    assert gold["AA", 2025, "M4"].metric_status == "UNAVAILABLE_INPUT"
    silver = to_silver(bronze(rows), fingerprint="F", processed_at=NOW)
    assert [r.definitions for r in mixed_definitions(silver).collect()] == [2]


def test_null_year_is_never_matched(gold_of):
    gold = gold_of([cell("AA", "20x1", "1"), cell("AA", "20x2", "2")]).collect()
    assert len(gold) == 6
    assert {r.metric_status for r in gold if r.metric_type == "DIRECT"} == {"UNAVAILABLE"}
    assert {r.prior_input_status for r in gold if r.metric_type == "DERIVED"} == {"UNAVAILABLE"}


def test_contract_and_audit(gold_of, bronze):
    gold = gold_of([cell("AA", 2024, "1"), cell("AA", 2025, "C")])
    assert dict(gold.dtypes) == GOLD_TYPES
    assert {r.check_name: r.rows for r in audit_gold(gold).collect()} == {
        "protected_numeric_leaks": 0,
        "unavailable_numeric_leaks": 0,
        "missing_lineage_rows": 0,
        "repeated_grain_rows": 0,
    }
    assert sum(r.rows for r in metric_status_counts(gold).collect()) == 12
    silver = to_silver(bronze([{}]), fingerprint="F", processed_at=NOW)
    with pytest.raises(SchemaContractError):
        build_gold(silver.drop("units"), fingerprint="G", processed_at=NOW)


def joins_of(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [kind for line in plan.splitlines() for kind in ("BroadcastHashJoin", "SortMergeJoin") if kind in line]


def test_no_side_that_grows_is_broadcast(spark, bronze):
    """However small the files are taken to be: of group facts only the hot groups are broadcast."""
    rows = stage(bronze([cell("CC", 2024, "1"), cell("CC", 2025, "2")]), "bronze")
    silver = stage(to_silver(rows, fingerprint="F", processed_at=NOW), "silver")
    gold = stage(build_gold(silver, fingerprint="G", processed_at=NOW), "gold")
    assert joins_of(gold_lineage(silver, gold)) == ["SortMergeJoin"]
    assert gold_lineage(silver, gold).count() == 5
    sizes = stage(rows.groupBy("Year").agg(F.count("*").alias("year_rows")), "sizes")
    attached = attach_group_facts(rows.select("Year"), sizes, ["Year"], "year_rows")
    assert sorted(joins_of(attached)) == ["BroadcastHashJoin", "SortMergeJoin"]
    assert [r.year_rows for r in attached.collect()] == [1, 1]


def test_no_generated_method_is_too_long_to_be_compiled(spark, bronze):
    """Past HotSpot's limit every row would go through the interpreter; Spark then runs operator by operator."""
    rows = stage(bronze([cell("CC", 2024, "1"), cell("CC", 2025, "2")]), "bronze")
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(limit)
    silver = stage(to_silver(rows, fingerprint="F", processed_at=NOW), "silver")
    assert spark.conf.get(limit) == "8000"
    spark.conf.unset(limit)
    build_gold(silver, fingerprint="G", processed_at=NOW)
    assert spark.conf.get(limit) == "8000"
    spark.conf.set(limit, "4000")
    build_gold(silver, fingerprint="G", processed_at=NOW)
    assert spark.conf.get(limit) == "4000"
    spark.conf.unset(limit)


def test_unread_inputs_are_not_computed(spark, bronze):
    """A count by level needs no values, statuses or lineage: none of them is aggregated or shuffled."""
    rows = stage(bronze([cell("CC", 2024, "1"), cell("CC", 2025, "2")]), "bronze")
    silver = stage(to_silver(rows, fingerprint="F", processed_at=NOW), "silver")
    gold = build_gold(silver, fingerprint="G", processed_at=NOW)
    levels = level_counts(gold)
    plan = levels._jdf.queryExecution().executedPlan().toString()
    assert not [name for name in ("record_id", "source_sha256", "value_numeric", "Window") if name in plan]
    assert [r.rows for r in levels.collect()] == [12]
    plan = metric_status_counts(gold)._jdf.queryExecution().executedPlan().toString()
    assert not [name for name in ("record_id", "source_sha256", "collect_set") if name in plan]


def test_keys_are_sorted_by_what_tells_rows_apart(spark, bronze):
    """Sorts compare a few bytes of the first key; years and levels are the same for millions of rows."""
    rows = stage(bronze([cell("CC", 2024, "1"), cell("CC", 2025, "2")]), "bronze")
    silver = to_silver(rows, fingerprint="F", processed_at=NOW)
    for frame in (select_current(rows), build_gold(silver, fingerprint="G", processed_at=NOW)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        first = re.findall(r"Sort \[(\w+?)#", plan)
        assert first and not {"Year", "year", "Industry_aggregation_NZSIOC", "industry_aggregation_nzsioc"} & set(first)


def test_industry_years_are_dealt_out_before_they_become_six_rows(spark, bronze, gold_of):
    """Ranges are sampled and shuffled on one narrow row per industry and year, and give the same Gold."""
    rows = [cell(f"C{i}", year, str(i), kind) for i in range(30) for year in (2023, 2024, 2026) for kind in (INCOME, SURPLUS)]
    ranges = ("industry_aggregation_nzsioc", "year", "industry_code_nzsioc")
    dealt, plain = gold_of(rows, ranges=ranges), gold_of(rows)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and 0 < plan.index("Expand") < plan.index("rangepartitioning")
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    order = ("metric_id", *ranges)
    for part in dealt.rdd.glom().collect():
        assert part == sorted(part, key=lambda r: tuple(r[name] for name in order))
    assert {r.prior_input_status for r in dealt.where("year = 2026 AND metric_id = 'M4'").collect()} == {"UNAVAILABLE"}
    assert {r.prior_input_status for r in dealt.where("year = 2024 AND metric_id = 'M4'").collect()} == {"PUBLISHED"}


def test_gold_is_audited_in_one_pass(gold_of):
    """Rows twice and a value under a protected status; a second check is not a second scan."""
    gold = gold_of([cell("AA", 2024, "1"), cell("AA", 2025, "C")])
    leak = gold.where("metric_id = 'M1' AND year = 2025").withColumn("metric_value", F.lit(1).cast("decimal(38,18)"))
    stored = stage(gold.unionByName(gold).unionByName(leak), "audited")
    audited = audit_gold(stored)
    assert {r.check_name: r.rows for r in audited.collect()} == {
        "protected_numeric_leaks": 1,
        "unavailable_numeric_leaks": 1,
        "missing_lineage_rows": 0,
        "repeated_grain_rows": 13,
    }
    assert audited._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert {r.rows for r in audit_gold(stored.limit(0)).collect()} == {0}


def test_a_known_fingerprint_is_not_collected(bronze):
    """Gold is the same, and its aggregates hold no objects."""
    rows = bronze([cell("AA", 2024, "1"), cell("AA", 2025, "C"), cell("BB", 2025, "3")])
    silver = to_silver(rows, fingerprint="F", processed_at=NOW)
    plain, known = (build_gold(silver, fingerprint="G", processed_at=NOW, silver_fingerprint=f) for f in (None, "F"))
    assert sorted(map(repr, known.collect())) == sorted(map(repr, plain.collect()))
    aggregated = [gold._jdf.queryExecution().optimizedPlan().toString().count("collect_set") for gold in (plain, known)]
    assert aggregated[0] and not aggregated[1]
