"""Bronze rows: raw text plus artifact identity and row lineage."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import BRONZE_TYPES, METADATA_TYPES, RAW_COLUMNS, RAW_SCHEMA_VERSION
from tallymark.operators.schema_check import require_columns

BRONZE_COLUMNS = tuple(BRONZE_TYPES)


@dataclass(frozen=True)
class ArtifactMetadata:
    """Identity and origin of one source file."""

    ingestion_id: str
    source_file: str
    source_url: str
    source_sha256: str
    dataset_year: int
    dataset_version: str
    ingestion_timestamp: str  # ISO 8601 with an offset
    row_count: int
    schema_version: str = RAW_SCHEMA_VERSION

    def to_dict(self) -> dict:
        return asdict(self)


def parse_instant(text: str) -> datetime:
    """ISO-8601 text with a required offset, as an aware UTC time."""
    try:
        parsed = datetime.fromisoformat(text)
    except ValueError as error:
        raise ValueError(f"Not an ISO-8601 timestamp: {text!r}.") from error
    return as_utc(parsed)


def as_utc(value: datetime) -> datetime:
    if value.utcoffset() is None:
        raise ValueError("A timestamp needs a time zone.")
    return value.astimezone(UTC)


def iso_instant(value: datetime) -> str:
    return as_utc(value).isoformat().replace("+00:00", "Z")


def to_bronze(raw: DataFrame, metadata: ArtifactMetadata) -> DataFrame:
    """Attach the metadata of one artifact to its numbered raw rows.

    ``raw`` holds the ten text columns and ``source_row_number``; its row count is
    checked against the metadata when the artifact is read and again when it is stored.
    """
    require_columns(raw, [*RAW_COLUMNS, "source_row_number"], "Raw observations")
    # The offset stays in the literal, so the session time zone does not matter.
    instant = iso_instant(parse_instant(metadata.ingestion_timestamp))
    values = {**metadata.to_dict(), "ingestion_timestamp": instant}
    return raw.select(
        *RAW_COLUMNS,
        *[F.lit(values[name]).cast(kind).alias(name) for name, kind in METADATA_TYPES.items()],
        F.col("source_row_number").cast("bigint").alias("source_row_number"),
    )
