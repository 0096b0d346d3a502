"""Release tables, snapshot tables and the artifact registry on plain Parquet.

Single writer, as usual for a yearly release. Data is written first, checked, and made
visible by one appended row: the facts of an artifact in Bronze, the pointer of a
snapshot. What a failed run left is never read, and a repeated run leaves one copy. In a
folder an artifact's partition is replaced; a catalog table, which can only be appended
to, names the attempt of every row, and readers keep the attempts that were committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymark.contracts import BRONZE_TYPES, METADATA_TYPES, ddl, struct_type
from tallymark.errors import IntegrityError, SourceTableError
from tallymark.operators.bronze import ArtifactMetadata, iso_instant, parse_instant
from tallymark.operators.serving import table_identifier
from tallymark.operators.silver import FACT_TYPES, artifact_facts
from tallymark.session import shuffles_freed

ATTEMPT = "attempt_id"
#: Ids are digests in hexadecimal, of which zstd keeps half and the default codec all.
_WRITER = {"parquet": {"compression": "zstd"}}


class PathStore:
    """A table that is a folder of files."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet") -> None:
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt

    def exists(self) -> bool:
        """Whether the folder is there, asked of its file system; no file is read."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def read(self, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.format(self.fmt)
        return (reader.schema(schema) if schema else reader).load(self.path)

    def write(self, frame: DataFrame, mode: str, **options: str) -> None:
        partition = options.pop("partitionBy", None)
        writer = frame.write.format(self.fmt).mode(mode).options(**{**_WRITER.get(self.fmt, {}), **options})
        with shuffles_freed(self.spark):
            (writer.partitionBy(partition) if partition else writer).save(self.path)

    def sibling(self, name: str) -> PathStore:
        """A table beside this one."""
        return PathStore(self.spark, f"{self.path}_{name}", self.fmt)

    def write_attempt(self, frame: DataFrame, column: str) -> str:
        """Write whole partitions; a retried write replaces what it wrote before."""
        self.write(frame, "overwrite", partitionBy=column, partitionOverwriteMode="dynamic")
        return ""


class CatalogStore:
    """A table known to the session catalog by name."""

    def __init__(self, spark: SparkSession, *name: str, fmt: str = "parquet") -> None:
        self.spark, self.parts, self.name, self.fmt = spark, name, table_identifier(*name), fmt

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self, schema: str | None = None) -> DataFrame:
        return self.spark.table(self.name)

    def write(self, frame: DataFrame, mode: str, **options) -> None:
        partition = options.pop("partitionBy", None)
        writer = frame.write.format(self.fmt).mode(mode).options(**{**_WRITER.get(self.fmt, {}), **options})
        with shuffles_freed(self.spark):
            (writer.partitionBy(partition) if partition else writer).saveAsTable(self.name)

    def sibling(self, name: str) -> CatalogStore:
        return CatalogStore(self.spark, *self.parts[:-1], f"{self.parts[-1]}_{name}", fmt=self.fmt)

    def write_attempt(self, frame: DataFrame, *columns: str) -> str:
        """Append rows under a new attempt; they count once someone commits that attempt."""
        attempt = uuid.uuid4().hex
        self.write(frame.withColumn(ATTEMPT, F.lit(attempt)), "append", partitionBy=[ATTEMPT, *columns])
        return attempt


def require_rows(store, what: str, schema: str | None = None) -> DataFrame:
    """The stored table, or an error when it is missing or empty."""
    if not store.exists():
        raise SourceTableError(f"{what} does not exist.")
    frame = store.read(schema)
    if frame.isEmpty():
        raise SourceTableError(f"{what} has no rows.")
    return frame


@dataclass(frozen=True)
class AppendResult:
    ingestion_id: str
    inserted_rows: int
    total_rows: int
    duplicate: bool


class BronzeTable:
    """Append-only release history, one partition per artifact.

    The facts beside it (rows, digests, whether row numbers repeat) commit an artifact:
    rows without facts are not read. They also answer what would else need a scan.
    """

    def __init__(self, store: PathStore | CatalogStore) -> None:
        self.store, self._facts = store, store.sibling("facts")

    def exists(self) -> bool:
        return self._facts.exists() or self.store.exists()

    def facts(self) -> DataFrame:
        """One row per artifact and digest, from the facts table; of a table without one, by a scan."""
        columns = [*FACT_TYPES, ATTEMPT]
        if self._facts.exists():
            return self._facts.read(ddl({**FACT_TYPES, ATTEMPT: "string"})).select(*columns)
        # Rows with attempts and no facts are uncommitted ones, not an older table's.
        if not self.store.exists() or ATTEMPT in self._stored().columns:
            return self.store.spark.createDataFrame([], ddl({**FACT_TYPES, ATTEMPT: "string"}))
        found = artifact_facts(self._stored()).withColumn(ATTEMPT, F.lit(""))
        self._facts.write(found.select(*columns), "append")
        return self.facts()

    def _stored(self) -> DataFrame:
        # The explicit schema keeps an all-digit partition value from becoming a number.
        return self.store.read(ddl(BRONZE_TYPES))

    def read(self) -> DataFrame:
        rows, committed = self._stored(), self.facts().select("ingestion_id", ATTEMPT).distinct()
        if ATTEMPT not in rows.columns:
            rows = rows.withColumn(ATTEMPT, F.lit(""))
        return rows.join(committed, ["ingestion_id", ATTEMPT], "left_semi").select(*BRONZE_TYPES)

    def require(self) -> DataFrame:
        if not self.exists():
            raise SourceTableError("The Bronze table does not exist.")
        if self.facts().isEmpty():
            raise SourceTableError("The Bronze table has no rows.")
        return self.read()

    def artifacts(self) -> DataFrame:
        """Distinct (ingestion_id, source_sha256)."""
        return self.facts().select("ingestion_id", "source_sha256").distinct()

    def rows_of(self, ingestion_id: str) -> int:
        return self._rows(F.col("ingestion_id") == ingestion_id)

    def _rows(self, which: Column) -> int:
        return self.facts().where(which).agg(F.coalesce(F.sum("artifact_rows"), F.lit(0))).first()[0]

    def holds_only(self, ingestion_id: str) -> bool:
        """Whether nothing but this artifact is stored (guard of an initial load)."""
        return self.facts().where(F.col("ingestion_id") != ingestion_id).isEmpty()

    def append(self, rows: DataFrame, ingestion_id: str, expected_rows: int) -> AppendResult:
        """Store an artifact once; a second call with the same artifact changes nothing."""
        stored = self.rows_of(ingestion_id)
        if stored and stored != expected_rows:
            raise IntegrityError(
                f"Bronze holds {stored} rows of {ingestion_id}, expected {expected_rows}."
            )
        if not stored:
            if not self._facts.exists():
                # From here on, rows without facts are those of a failed run.
                self._facts.write(self.facts().limit(0), "append")
            attempt = self.store.write_attempt(rows, "ingestion_id")
            mine = self._stored().where(F.col("ingestion_id") == ingestion_id)
            mine = mine.where(F.col(ATTEMPT) == attempt) if attempt else mine
            facts = artifact_facts(mine).withColumn(ATTEMPT, F.lit(attempt)).collect()
            written = sum(row["artifact_rows"] for row in facts)
            if written != expected_rows:
                raise IntegrityError(
                    f"Bronze stored {written} rows of {ingestion_id}, expected {expected_rows}."
                )
            # As many rows as the artifact has digests: one, unless its lineage is wrong.
            commit = self.store.spark.createDataFrame(facts, struct_type({**FACT_TYPES, ATTEMPT: "string"}))
            self._facts.write(commit.coalesce(1), "append")
        return AppendResult(
            ingestion_id, 0 if stored else expected_rows, self._rows(F.lit(True)), bool(stored)
        )


@dataclass(frozen=True)
class SnapshotResult:
    fingerprint: str
    rows: int
    duplicate: bool
    #: What was counted while the rows were written.
    counts: Mapping[str, int] = field(default_factory=dict)


_POINTER = (
    "fingerprint STRING, schema_version STRING, rows BIGINT, counts MAP<STRING, BIGINT>, location STRING, published BIGINT"
)
#: Tables derived from the stored rows and published with them, by name; laid out by what the
#: snapshot table names for them, or as they come.
Beside = Mapping[str, Callable[[DataFrame], DataFrame]]


class SnapshotTable:
    """A table replaced as a whole; readers follow the newest pointer.

    Every snapshot is written to a place of its own, together with tables that belong to
    it, and all become current by one appended pointer row: a failed write is never
    visible and older snapshots stay readable. In a folder that place is a folder, in a
    catalog the rows of one attempt, a partition of the table.
    """

    def __init__(
        self, spark: SparkSession, place: str | CatalogStore, types: dict[str, str], fmt: str = "parquet",
        *, partition: str | None = None, sort: tuple[str, ...] = (), beside: dict[str, tuple[str, ...]] | None = None,
    ) -> None:
        self.spark, self.types, self.fmt = spark, types, fmt
        self.partition, self.sort, self.beside = partition, sort, beside or {}
        self.store = place if isinstance(place, CatalogStore) else None
        self.path = place.rstrip("/") if self.store is None else place.name
        self.pointers = PathStore(spark, f"{self.path}/pointers", "json") if self.store is None else self.store.sibling("commits")

    def history(self) -> DataFrame:
        return self.pointers.read(_POINTER)

    def pointer(self):
        if not self.pointers.exists():
            return None
        return self.history().orderBy(F.desc("published"), F.desc("location")).first()

    def exists(self) -> bool:
        return self.pointer() is not None

    def _write(self, frame: DataFrame, location: str, table: str | None = None) -> str:
        """Store rows, where reading a place back is up to ``_at``; the place is returned."""
        if self.store is not None:
            store = self.store.sibling(table) if table else self.store
            columns = [self.partition] if self.partition and not table else []
            rows = frame.withColumn(ATTEMPT, F.lit(location))
            store.write(rows, "append", partitionBy=[ATTEMPT, *columns])
            return location
        writer = frame.write.format(self.fmt).mode("errorifexists").options(**_WRITER.get(self.fmt, {}))
        with shuffles_freed(self.spark):
            (writer.partitionBy(self.partition) if self.partition and not table else writer).save(self._folder(location, table))
        return location

    def _folder(self, location: str, table: str | None) -> str:
        return f"{self.path}/{table}/{location.rsplit('/', 1)[-1]}" if table else f"{self.path}/{location}"

    def _at(self, location: str, table: str | None = None) -> DataFrame:
        if self.store is not None:
            store = self.store.sibling(table) if table else self.store
            rows = store.read().where(F.col(ATTEMPT) == location)
            return rows.drop(ATTEMPT) if table else rows.select(*self.types)
        reader = self.spark.read.format(self.fmt)
        if table:
            return reader.load(self._folder(location, table))
        return reader.schema(struct_type(self.types)).load(self._folder(location, None)).select(*self.types)

    def read(self, schema: str | None = None, *, table: str | None = None) -> DataFrame:
        """The current rows, or those of a table published beside them."""
        current = self.pointer()
        if current is None:
            raise SourceTableError(f"No snapshot at {self.path}.")
        return self._at(current["location"], table)

    def require(self, what: str) -> DataFrame:
        return require_rows(self, what)

    def fingerprints(self) -> DataFrame:
        """The stored fingerprint, as zero or one row."""
        current = self.pointer()
        rows = [] if current is None else [(current["fingerprint"],)]
        return self.spark.createDataFrame(rows, "fingerprint STRING")

    def is_current(self, fingerprint: str, schema_version: str) -> bool:
        current = self.pointer()
        return (
            current is not None
            and current["fingerprint"] == fingerprint
            and current["schema_version"] == schema_version
        )

    def reuse(self, fingerprint: str, expected_rows: int | None = None) -> SnapshotResult:
        """The published snapshot, after checking that it is complete."""
        pointer = self.pointer()
        rows, stated = self._at(pointer["location"]).count(), pointer["rows"]
        if rows != stated or expected_rows not in (None, rows):
            raise IntegrityError(f"{self.path} holds {rows} rows, stated {stated}, expected {expected_rows}.")
        return SnapshotResult(fingerprint, rows, True, pointer["counts"] or {})

    def publish(
        self, frame: DataFrame, fingerprint: str, schema_version: str, expected_rows: int | None = None,
        *, counts: Mapping[str, Column] | None = None, beside: Beside | None = None, arranged: bool = False,
    ) -> SnapshotResult:
        """Replace the snapshot unless the same fingerprint is already published.

        Rows that come ``arranged``, in ranges and sorted by partition and then as the table
        is, are written as they come; others are brought into that order first.

        Rows are counted as they are written, with whatever else ``counts`` asks for, and
        compared with what is stored, and with the ``expected_rows`` of the input where
        the caller has them. All of this comes before the pointer.
        """
        if self.is_current(fingerprint, schema_version):
            return self.reuse(fingerprint, expected_rows)
        if self.partition and not arranged:
            frame = laid_out(frame, self.partition, *self.sort)
        written = Observation()
        asked = {name: column.alias(name) for name, column in (counts or {}).items()}
        # Above the exchange: its sampling of key ranges must not be counted.
        observed = frame.observe(written, F.count(F.lit(1)).alias("rows"), *asked.values())
        attempt = uuid.uuid4().hex
        location = self._write(observed, attempt if self.store is not None else f"snapshots/snapshot={fingerprint}/{attempt}")
        stored = self._at(location)
        rows, seen = stored.count(), written.get
        if rows != seen["rows"] or expected_rows not in (None, rows):
            raise IntegrityError(f"{self.path} would hold {rows} rows of {seen['rows']}, expected {expected_rows}.")
        for name, made in (beside or {}).items():
            order = self.beside[name]
            self._write(laid_out(made(stored), *order) if order else made(stored), location, name)
        last = self.pointer()
        found = {name: int(seen[name]) for name in asked}
        # Pointers are numbered: a clock set back cannot hide a newer snapshot.
        pointer = (fingerprint, schema_version, rows, found, location, 1 + (last["published"] if last else 0))
        self.pointers.write(self.spark.createDataFrame([pointer], _POINTER).coalesce(1), "append")
        return SnapshotResult(fingerprint, rows, False, found)


def laid_out(frame: DataFrame, *order: str) -> DataFrame:
    """Rows in sorted ranges of about equal size, however often a key occurs.

    A reader that looks up a key or a range skips the other files and, by the statistics
    of row groups, most of a file.
    """
    return frame.repartitionByRange(*order).sortWithinPartitions(*order)


class ArtifactRegistry:
    """One row per artifact; the first registration of a digest wins."""

    def __init__(self, store: PathStore | CatalogStore) -> None:
        self.store = store

    def read(self) -> DataFrame:
        return self.store.read(ddl(METADATA_TYPES)).select(*METADATA_TYPES)

    def register(self, metadata: ArtifactMetadata) -> tuple[ArtifactMetadata, bool]:
        """The registered metadata and whether it was there before."""
        known = self.find(metadata.source_sha256)
        if known is not None:
            return known, True
        values = {
            **metadata.to_dict(),
            "ingestion_timestamp": parse_instant(metadata.ingestion_timestamp),
        }
        row = self.store.spark.createDataFrame(
            [tuple(values[name] for name in METADATA_TYPES)], struct_type(METADATA_TYPES)
        )
        self.store.write(row.coalesce(1), "append")
        return metadata, False

    def find(self, source_sha256: str) -> ArtifactMetadata | None:
        if not self.store.exists():
            return None
        found = (
            self.read()
            .where(F.col("source_sha256") == source_sha256)
            .withColumn("_seconds", F.unix_micros("ingestion_timestamp"))
            .orderBy("ingestion_timestamp")
            .first()
        )
        if found is None:
            return None
        values = found.asDict()
        return ArtifactMetadata(
            **{
                **{name: values[name] for name in METADATA_TYPES},
                "ingestion_timestamp": _instant(values["_seconds"]),
            }
        )


def _instant(micros: int) -> str:
    from datetime import UTC, datetime, timedelta

    return iso_instant(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=micros))
