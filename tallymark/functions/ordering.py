"""Exact 1-based positions in a total order, computed in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_in_buckets(
    rows: DataFrame,
    group: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str | Column],
    *,
    position: str,
    total: str,
) -> DataFrame:
    """Number each group's rows 1..n in (bucket, order) sequence and add n.

    Only a bucket is sorted as a unit; offsets come from a count per bucket. The
    join reuses the window's partitioning, so the rows are shuffled once.
    """
    whole = Window.partitionBy(*group)
    before = whole.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group, *bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *group,
            *bucket,
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(whole).alias(total),
        )
    )
    within = Window.partitionBy(*group, *bucket).orderBy(*order)
    return (
        rows.withColumn("_within", F.row_number().over(within))
        .join(offsets, [*group, *bucket])
        .withColumn(position, F.col("_offset") + F.col("_within"))
        .select(*rows.columns, position, total)
    )


#: Cut points per group: no stretch between two of them has much more than this share of it.
CUTS = 128
TIE_CUTS = 32


def number_by_cuts(
    rows: DataFrame,
    group: Sequence[str],
    score: str,
    ties: Sequence[str],
    position: str,
    most: int,
) -> DataFrame:
    """Number each group's rows 1..n by falling ``score``, then ``ties``, up to ``most``.

    Lazy, however large a group is. Approximate quantiles of a group, from one map-side
    combined aggregate, cut it into stretches; their sizes say where each begins, and
    whether it begins within ``most`` at all. Only the stretches that do are sorted, each
    by itself. A score on a cut point may be that of very many rows: it is a stretch of
    its own, cut further by the first letters of the first tie break, a text.

    Quantiles are broadcast, so ``group`` should have few values.
    """
    letters = f"coalesce(CAST(conv(rpad(hex(left({ties[0]}, 6)), 12, '0'), 16, 10) AS BIGINT), -1L)"
    scored = rows.withColumn("_score", F.expr(score))

    def quantiles(count: int) -> str:
        return "array(" + ", ".join(f"{i / count}D" for i in range(count + 1)) + ")"

    cuts = scored.withColumn("_letters", F.expr(letters)).groupBy(*group).agg(
        F.expr(f"approx_percentile(_score, {quantiles(CUTS)}, 1000) AS _cuts"),
        F.expr(f"approx_percentile(_letters, {quantiles(TIE_CUTS)}, 1000) AS _tie_cuts"),
    ).select(
        *(F.col(g).alias(f"_g_{g}") for g in group),
        # One key without nulls, so that the join below needs no shuffle of its own.
        F.to_json(F.struct(*group)).alias("_group"),
        F.array_distinct("_cuts").alias("_cuts"),
        F.array_distinct("_tie_cuts").alias("_tie_cuts"),
    )
    same = " AND ".join(f"{g} <=> _g_{g}" for g in group)
    near = _passed(scored.join(F.broadcast(cuts), F.expr(same)), "_cuts", "<=", "_score", "_reached", CUTS + 1)
    near = near.withColumn("_on_cut", F.expr("coalesce(get(_cuts, _reached - 1) = _score, false)"))
    near = near.withColumn("_letters", F.expr(f"CASE WHEN _on_cut THEN {letters} END"))
    placed = _passed(near, "_tie_cuts", "<", "_letters", "_part", TIE_CUTS + 1).selectExpr(
        *rows.columns,
        "_score",
        "_group",
        "2 * (size(_cuts) - _reached) + if(_on_cut, 1, 0) AS _stretch",
        "_part",
    )
    order = [F.desc("_score"), *map(F.asc, ties)]
    bucket = ["_stretch", "_part"]
    before = Window.partitionBy("_group").orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        placed.groupBy("_group", *bucket).agg(F.count(F.lit(1)).alias("_n"))
        .select("_group", *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
        .where(F.col("_offset") < most)
    )
    within = F.row_number().over(Window.partitionBy("_group", *bucket).orderBy(*order))
    return (
        placed.join(begins, ["_group", *bucket])
        .withColumn(position, (F.col("_offset") + within).cast("bigint"))
        .where(F.col(position) <= most)
        .select(*rows.columns, position)
    )


def _passed(rows: DataFrame, cuts: str, compared: str, value: str, name: str, most: int) -> DataFrame:
    """Add how many of the rising ``cuts``, ``most`` at most, stand in that relation to ``value``.

    Found by halving. Each step is a column of its own and stays in generated code, where
    a lambda over all cuts is interpreted for every one of them; none passes a null value.
    """
    rows = rows.withColumn(name, F.lit(0))
    for step in (1 << i for i in reversed(range(most.bit_length()))):
        rows = rows.withColumn(name, F.expr(f"{name} + if(get({cuts}, {name} + {step - 1}) {compared} {value}, {step}, 0)"))
    return rows
