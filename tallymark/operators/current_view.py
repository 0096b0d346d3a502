"""Which release is current for each observation key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.contracts import OBSERVATION_KEY
from tallymark.errors import AmbiguousReleaseError
from tallymark.functions.skew import HOT_MIN_ROWS, attach_group_facts
from tallymark.session import stage

# What tells most rows apart comes first: sorts compare 8 bytes of it before anything else.
_SORTED_KEY = ("Industry_code_NZSIOC", "Variable_code", "Year", "Industry_aggregation_NZSIOC")
_RELEASE_KEY = (*_SORTED_KEY, "dataset_year", "ingestion_id")


CURRENT_TYPES = {
    **{name: "string" for name in OBSERVATION_KEY},
    "dataset_year": "int",
    "ingestion_id": "string",
    "observation_rows": "bigint",
    "competing_releases": "bigint",
}


def current_releases(history: DataFrame) -> DataFrame:
    """The artifact(s) holding the greatest ``dataset_year`` of each key.

    One row per key and artifact with ``observation_rows`` (rows of the key in the
    artifact) and ``competing_releases`` (artifacts sharing the top year). Rows are
    counted map-side first, so the window sees one row per key and artifact.
    Keys with a null part never match anything and are left out.
    """
    return _topmost(_per_artifact(history))


def merged_releases(current: DataFrame, added: DataFrame) -> DataFrame:
    """``current_releases`` of a history to which the rows ``added`` of new artifacts came.

    The greatest year of a key never falls, so what was outdone before stays so and only
    ``current`` and the new rows are read.
    """
    return _topmost(current.drop("competing_releases").unionByName(_per_artifact(added)))


def _per_artifact(rows: DataFrame) -> DataFrame:
    complete = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in _RELEASE_KEY))
    return complete.groupBy(*OBSERVATION_KEY, "dataset_year", "ingestion_id").agg(F.count(F.lit(1)).alias("observation_rows"))


def _topmost(per_artifact: DataFrame) -> DataFrame:
    by_key = Window.partitionBy(*_SORTED_KEY)
    return (
        per_artifact.withColumn("_top", F.max("dataset_year").over(by_key))
        .where(F.col("dataset_year") == F.col("_top"))
        .drop("_top")
        .withColumn("competing_releases", F.count(F.lit(1)).over(by_key))
    )


def release_ambiguity(history: DataFrame) -> DataFrame:
    """Keys whose greatest ``dataset_year`` is claimed by several artifacts."""
    return (
        current_releases(history)
        .where(F.col("competing_releases") > 1)
        .groupBy(*OBSERVATION_KEY)
        .agg(F.max("competing_releases").alias("release_count"))
    )


def require_unambiguous(history: DataFrame, current: DataFrame | None = None) -> int:
    """How many rows are current; raise when a key has no single current artifact (one job).

    ``current`` are the history's current releases, where they are stored already.
    """
    totals = (current_releases(history) if current is None else current).agg(
        F.count_distinct(F.when(F.col("competing_releases") > 1, F.struct(*OBSERVATION_KEY))).alias("ambiguous"),
        F.coalesce(F.sum("observation_rows"), F.lit(0)).alias("rows"),
    )
    found = (stage(totals, "ambiguity") if current is None else totals).first()
    ambiguous = found["ambiguous"]
    if ambiguous:
        raise AmbiguousReleaseError(
            f"{ambiguous} observation(s) have several artifacts with the greatest "
            "dataset_year; dataset_version text does not order releases."
        )
    return found["rows"]


def select_current(
    history: DataFrame,
    *,
    with_counts: bool = False,
    current: DataFrame | None = None,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Rows of the current release of every key; every other row is history.

    Lazy: call :func:`require_unambiguous` first where ties are possible.
    ``with_counts`` keeps ``observation_rows`` for duplicate detection. With stored
    ``current`` releases the history is read once.
    """
    large = None
    if current is None:
        counted = _per_artifact(history)
        current = _topmost(counted)
        # Few keys have that many rows; only theirs are ranked once more for the hot side.
        keys = counted.where(F.col("observation_rows") >= hot_min_rows).select(*_SORTED_KEY).distinct()
        large = _topmost(counted.join(F.broadcast(keys), list(_SORTED_KEY), "left_semi")).drop("competing_releases")
    selected = attach_group_facts(
        history,
        current.drop("competing_releases"),
        _RELEASE_KEY,
        "observation_rows",
        required=True,
        hot_min_rows=hot_min_rows,
        large=large,
    )
    return selected if with_counts else selected.drop("observation_rows")
