from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import NOW, SHA_A, SHA_B

from tallymark.errors import AmbiguousReleaseError, SchemaContractError
from tallymark.operators.current_view import (
    release_ambiguity,
    require_unambiguous,
    select_current,
)
from tallymark.operators.silver import build_silver, failure_distribution, to_silver


def silver(frame, **options):
    return to_silver(frame, fingerprint="F", processed_at=NOW, **options)


def by_row(frame):
    return {row.source_row_number: row for row in frame.collect()}


def test_values_keep_their_class(bronze):
    texts = ["1,234.5", "-810", "C", "S", " ", "not-a-number", ".5", "5.", "1234,567", "+7", "9" * 30]
    rows = by_row(
        silver(bronze([{"Value": t, "Year": str(2000 + i)} for i, t in enumerate(texts)]))
    )
    found = [(rows[i + 1].value_status, rows[i + 1].value_numeric) for i in range(len(texts))]
    assert found == [
        ("PUBLISHED", Decimal("1234.5")),
        ("PUBLISHED", Decimal("-810")),
        ("CONFIDENTIAL", None),
        ("SUPPRESSED", None),
        ("UNAVAILABLE", None),
        ("INVALID", None),
        ("INVALID", None),
        ("INVALID", None),
        ("INVALID", None),
        ("PUBLISHED", Decimal("7")),
        ("INVALID", None),  # does not fit the value type
    ]
    assert rows[1].is_valid and rows[3].is_valid
    assert rows[5].validation_rule_ids == ["VALUE_UNAVAILABLE"]
    assert rows[6].validation_rule_ids == ["VALUE_INVALID"]
    assert rows[6].record_status == "INVALID"
    assert rows[1].record_id == f"{SHA_A}:1"


RULE_CASES = [
    ({"Year": " "}, "YEAR_REQUIRED"),
    ({"Year": None}, "YEAR_REQUIRED"),
    ({"Year": "20x5"}, "YEAR_INVALID_FORMAT"),
    ({"Year": "2025\n"}, "YEAR_INVALID_FORMAT"),
    ({"Industry_aggregation_NZSIOC": ""}, "INDUSTRY_AGGREGATION_REQUIRED"),
    ({"Industry_aggregation_NZSIOC": "Level 2"}, "INDUSTRY_AGGREGATION_UNEXPECTED"),
    ({"Industry_code_NZSIOC": ""}, "INDUSTRY_CODE_REQUIRED"),
    ({"Industry_name_NZSIOC": " "}, "INDUSTRY_NAME_REQUIRED"),
    ({"Industry_code_ANZSIC06": ""}, "ANZSIC_MAPPING_REQUIRED"),
    ({"Variable_code": ""}, "VARIABLE_CODE_REQUIRED"),
    ({"Variable_name": ""}, "VARIABLE_NAME_REQUIRED"),
    ({"Variable_category": ""}, "VARIABLE_CATEGORY_REQUIRED"),
    ({"Units": ""}, "UNITS_REQUIRED"),
    ({"Units": "Percentage"}, "VARIABLE_DEFINITION_UNEXPECTED"),
    ({"Variable_name": "total income"}, "VARIABLE_DEFINITION_UNEXPECTED"),
    ({"Value": ""}, "VALUE_UNAVAILABLE"),
    ({"Value": "5\n"}, "VALUE_INVALID"),
    ({"source_url": None}, "LINEAGE_REQUIRED"),
    ({"source_sha256": SHA_B}, "LINEAGE_ID_MISMATCH"),
    ({"source_row_number": 0}, "SOURCE_ROW_NUMBER_INVALID"),
    ({"source_row_number": 9}, "SOURCE_ROW_NUMBER_INVALID"),
    ({"row_count": 5}, "SOURCE_ROW_COUNT_MISMATCH"),
]


def test_each_rule(bronze):
    """One artifact per case, all in one frame."""
    rows = [
        {"ingestion_id": f"{n:064d}", "source_sha256": f"{n:064d}", **override}
        for n, (override, _) in enumerate(RULE_CASES)
    ]
    found = {int(row.ingestion_id): row for row in silver(bronze(rows)).collect()}
    for n, (override, rule) in enumerate(RULE_CASES):
        assert found[n].validation_rule_ids == [rule], override
        assert len(found[n].validation_failure_reasons) == 1
        assert not found[n].is_valid


def test_malformed_year_becomes_null_not_an_error(bronze):
    assert [r.year for r in silver(bronze([{"Year": "abcd"}, {"Year": "2024"}])).collect()] == [
        None,
        2024,
    ]


def test_repeated_labels_of_one_code_are_valid(bronze):
    rows = [
        {"Variable_code": code, "Variable_name": name, "Year": str(2000 + i)}
        for i, (code, name) in enumerate(
            [
                ("H04", "Sales of goods and services"),
                ("H04", "Sales, government funding, grants and subsidies"),
                ("H18", "Other Purchases and operating expenses"),
                ("H18", "Other purchases and operating expenses"),
            ]
        )
    ]
    assert all(row.is_valid for row in silver(bronze(rows)).collect())


@pytest.mark.parametrize("hot_min_rows", [1, 1_000_000])
def test_duplicates_flag_all_members_but_no_other_level(bronze, hot_min_rows):
    frame = bronze([{}, {}, {"Industry_aggregation_NZSIOC": "Level 3"}, {"Year": None}, {"Year": None}])
    rows = by_row(silver(frame, hot_min_rows=hot_min_rows))
    flagged = [n for n, row in rows.items() if "OBSERVATION_DUPLICATE" in row.validation_rule_ids]
    assert sorted(flagged) == [1, 2, 4, 5]
    assert len(rows) == 5


@pytest.mark.parametrize("many", [True, False])
@pytest.mark.parametrize("hot_min_rows", [1, 1_000_000])
def test_repeated_row_numbers(bronze, hot_min_rows, many):
    frame = bronze(
        [{"Year": "2020"}, {"Year": "2021", "source_row_number": 1}, {"Year": "2022"}]
    )
    rows = silver(frame, hot_min_rows=hot_min_rows, many_artifacts=many).collect()
    assert sorted(r.year for r in rows if "SOURCE_ROW_NUMBER_DUPLICATE" in r.validation_rule_ids) == [
        2020,
        2021,
    ]
    assert all("SOURCE_ROW_COUNT_MISMATCH" not in r.validation_rule_ids for r in rows)


def releases(*rows):
    """(artifact, dataset_year, year, value) tuples as Bronze overrides."""
    return [
        {"ingestion_id": a, "source_sha256": a, "dataset_year": d, "Year": y, "Value": v}
        for a, d, y, v in rows
    ]


@pytest.mark.parametrize("hot_min_rows", [1, 1_000_000])
def test_partial_revision_keeps_untouched_rows_valid(bronze, hot_min_rows):
    history = bronze(
        releases(
            (SHA_A, 2025, "2023", "1"), (SHA_A, 2025, "2024", "2"), (SHA_B, 2026, "2024", "3")
        )
    )
    rows = build_silver(
        history, fingerprint="F", processed_at=NOW, hot_min_rows=hot_min_rows
    ).collect()
    assert sorted((r.year, r.value_raw, r.is_valid) for r in rows) == [
        (2023, "1", True),
        (2024, "3", True),
    ]


def test_current_view_ignores_version_text_and_keeps_duplicates(bronze):
    history = bronze(
        releases(
            (SHA_A, 2025, "2024", "old"), (SHA_B, 2026, "2024", "new"), (SHA_B, 2026, "2024", "new2")
        )
    )
    assert sorted(r.Value for r in select_current(history).collect()) == ["new", "new2"]


def test_tied_releases_are_ambiguous(bronze):
    history = bronze(
        releases((SHA_A, 2025, "2024", "1"), (SHA_B, 2025, "2024", "2"), (SHA_A, 2025, "2023", "1"))
    )
    ties = release_ambiguity(history).collect()
    assert [(t.Year, t.release_count) for t in ties] == [("2024", 2)]
    with pytest.raises(AmbiguousReleaseError):
        require_unambiguous(history)


def test_rows_with_null_keys_are_not_current(bronze):
    history = bronze([{"Year": None}, {"Year": "2024"}])
    assert select_current(history).count() == 1


def test_failure_distribution(bronze):
    counts = failure_distribution(silver(bronze([{"Value": "x"}, {"Value": "y"}]))).collect()
    assert {r.rule_id: r.rows for r in counts} == {"VALUE_INVALID": 2, "OBSERVATION_DUPLICATE": 2}


def test_column_order_is_part_of_the_contract(bronze):
    frame = bronze([{}])
    with pytest.raises(SchemaContractError):
        silver(frame.select(*reversed(frame.columns)))
    with pytest.raises(SchemaContractError):
        silver(frame.drop("Value"))
