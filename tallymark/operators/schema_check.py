"""Schema contracts in three strictness modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallymark.errors import SchemaContractError

ORDERED = "ordered"
EXACT = "exact"
SUBSET = "subset"


@dataclass(frozen=True)
class SchemaDifference:
    missing: tuple[str, ...]
    unexpected: tuple[str, ...]
    mismatched: dict[str, tuple[str, str]]  # column -> (expected, actual)


def compare_schema(frame: DataFrame, contract: dict[str, str]) -> SchemaDifference:
    actual = {field.name: field.dataType.simpleString() for field in frame.schema.fields}
    return SchemaDifference(
        missing=tuple(sorted(contract.keys() - actual.keys())),
        unexpected=tuple(sorted(actual.keys() - contract.keys())),
        mismatched={
            name: (contract[name], actual[name])
            for name in sorted(contract.keys() & actual.keys())
            if contract[name] != actual[name]
        },
    )


def check_schema(frame: DataFrame, contract: dict[str, str], mode: str, subject: str) -> None:
    """Raise unless ``frame`` meets ``contract``.

    ``ordered`` wants the same columns in the same order, ``exact`` the same set,
    ``subset`` allows further columns. Types always have to agree.
    """
    difference = compare_schema(frame, contract)
    broken = bool(difference.missing or difference.mismatched)
    if mode != SUBSET:
        broken = broken or bool(difference.unexpected)
    if mode == ORDERED:
        broken = broken or frame.columns != list(contract)
    if broken:
        raise SchemaContractError(
            f"{subject} does not meet its contract: missing {list(difference.missing)}, "
            f"unexpected {list(difference.unexpected)}, types {difference.mismatched}, "
            f"columns {frame.columns}."
        )


def require_columns(frame: DataFrame, names, subject: str) -> None:
    missing = sorted(set(names) - set(frame.columns))
    if missing:
        raise SchemaContractError(f"{subject} lacks the columns {missing}.")
