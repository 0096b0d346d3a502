"""Row digests, content fingerprints and release identities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.contracts import (
    GOLD_LOGIC_VERSION,
    GOLD_SCHEMA_VERSION,
    RAW_COLUMNS,
    REVISION_VERSION,
)
from tallymark.functions.text import UNIT_SEPARATOR


def row_digest(columns: Sequence[str] = RAW_COLUMNS) -> Column:
    """SHA-256 over a row's text, nulls marked (lower-case hex)."""
    marked = ", ".join(f"coalesce(`{name}`, '<null>')" for name in columns)
    return F.expr(f"sha2(concat_ws('{UNIT_SEPARATOR}', {marked}), 256)")


def digest_lines(lines: Column) -> Column:
    """Upper-case SHA-256 of an array of lines joined by line breaks."""
    return F.upper(F.sha2(F.array_join(lines, "\n"), 256))


def silver_fingerprint(artifacts: DataFrame) -> DataFrame:
    """One row: the fingerprint of a set of (ingestion_id, source_sha256) artifacts.

    Rows are reduced to distinct artifacts map-side; the sorted set holds one
    entry per artifact file, not per observation.
    """
    return (
        artifacts.select("ingestion_id", "source_sha256")
        .distinct()
        .agg(
            digest_lines(
                F.array_sort(F.collect_set(F.concat_ws(":", "ingestion_id", "source_sha256")))
            ).alias("fingerprint")
        )
    )


def gold_fingerprint(fingerprints: DataFrame, column: str = "silver_input_fingerprint") -> DataFrame:
    """One row: the Gold fingerprint of a set of Silver fingerprints."""
    versions = F.array(F.lit(GOLD_SCHEMA_VERSION), F.lit(GOLD_LOGIC_VERSION))
    return (
        fingerprints.select(column)
        .distinct()
        .agg(
            digest_lines(F.concat(versions, F.array_sort(F.collect_set(column)))).alias(
                "fingerprint"
            )
        )
    )


def revision_fingerprint(previous: DataFrame, incoming_sha: str) -> DataFrame:
    """One row: the identity of a revision of the releases ``previous(source_sha256)`` by another."""
    lines = F.array_sort(F.collect_set(F.when(F.col("source_sha256") != incoming_sha, F.col("source_sha256"))))
    whole = F.concat(F.array(F.lit(REVISION_VERSION)), lines, F.array(F.lit(incoming_sha)))
    return previous.select("source_sha256").distinct().agg(digest_lines(whole).alias("fingerprint"))


def sha256_lines(lines: Iterable[str]) -> str:
    """Driver-side twin of :func:`digest_lines` for a handful of identities."""
    return hashlib.sha256("\n".join(lines).encode("utf-8")).hexdigest().upper()


def silver_fingerprint_of(identities: Iterable[tuple[str, str]]) -> str:
    return sha256_lines(f"{artifact}:{sha}" for artifact, sha in sorted(set(identities)))


def gold_fingerprint_of(silver_fingerprints: Iterable[str]) -> str:
    return sha256_lines(
        [GOLD_SCHEMA_VERSION, GOLD_LOGIC_VERSION, *sorted(set(silver_fingerprints))]
    )


def revision_id_of(previous_shas: Iterable[str], incoming_sha: str) -> str:
    return sha256_lines([REVISION_VERSION, *sorted(previous_shas), incoming_sha])
