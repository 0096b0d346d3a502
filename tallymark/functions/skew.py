"""Attach per-group facts to rows without gathering a group in one task.

A window over a key puts the whole group into one task, and a plain join does the
same once the key is hot. Here the facts come from a map-side combined ``groupBy``;
the largest groups are joined by broadcast and their rows are spread by a salt, so
no task sees more than a bounded share of the data whatever the key distribution. The
others never are: there is a fact per key, and Parquet makes millions of them look small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The broadcast side never exceeds HOT_GROUPS rows. With N rows in total, every
# group outside it has at most N / HOT_GROUPS rows.
HOT_GROUPS = 10_000
HOT_MIN_ROWS = 1_000_000
SALTS = 4_096


def attach_group_facts(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    size: str,
    *,
    null_safe: bool = False,
    required: bool = False,
    hot_min_rows: int = HOT_MIN_ROWS,
    large: DataFrame | None = None,
) -> DataFrame:
    """Left join (inner if ``required``) of ``rows`` with one fact row per key.

    ``facts`` has ``keys`` (unique), the group's row count ``size`` and any further
    columns; all but the keys are added to the rows. ``null_safe`` lets null keys
    match each other, as they do in a window. ``large`` has at least those facts that
    reach ``hot_min_rows``, where they are found at less cost than in ``facts``. Rows are
    sorted by ``keys`` in their order.
    """
    added = [name for name in facts.columns if name not in keys]
    packed = f"struct({', '.join(added)})"
    hot = (
        (facts if large is None else large).where(f"{size} >= {hot_min_rows}")
        .orderBy(F.desc(size))
        .limit(HOT_GROUPS)
        .selectExpr(*[f"{key} AS _hot_{key}" for key in keys], f"{packed} AS _hot")
    )
    cold = facts.selectExpr(
        *[f"{key} AS _cold_{key}" for key in keys], f"{packed} AS _cold", "0 AS _cold_salt"
    )
    equals = "<=>" if null_safe else "="
    on_hot = " AND ".join(f"{key} {equals} _hot_{key}" for key in keys)
    on_cold = " AND ".join(f"{key} {equals} _cold_{key}" for key in keys)
    # Partition id and row content only: a retried task salts its rows the same way.
    content = ", ".join(f"`{name}`" for name in rows.columns)
    salt = f"""CASE WHEN _hot IS NULL THEN 0 ELSE
        1 + CAST(pmod(xxhash64(spark_partition_id(), {content}), {SALTS}) AS INT) END"""
    joined = (
        rows.join(F.broadcast(hot), F.expr(on_hot), "left")
        .withColumn("_salt", F.expr(salt))
        .join(cold.hint("merge"), F.expr(f"{on_cold} AND _salt = _cold_salt"), "left")
    )
    if required:
        joined = joined.where("_hot IS NOT NULL OR _cold IS NOT NULL")
    return joined.selectExpr(
        *[f"`{name}`" for name in rows.columns],
        *[f"coalesce(_hot.{name}, _cold.{name}) AS {name}" for name in added],
    )
