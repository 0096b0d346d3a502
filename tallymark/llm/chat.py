"""Dialogues seen by each of their speakers in turn (operator 2), in SQL functions only.

For every speaker of a conversation the dialogue is rendered once with that speaker as
the assistant and everyone else as a user under the own name; what the assistant says is
what a model is to learn, and its spans are the mask. ``CONTEXT`` roles are no speakers:
they stay what they are in every rendering and are never learned.

Rendered form: ``<|role|>text<|end|>`` per turn with a line break after each, a user's
text headed by ``name: ``. Spans are code points, end exclusive, of the assistant's text
and its end mark.

A conversation may be of any length. It is cut by turn number into bands of ``TURNS``
turns and these into parts of ``TURNS`` rows at most; parts of a rendering, in order of
band and part, make up the whole. Places in a band are running sums: rows are counted,
sorted into ranges of equal size and numbered within their range, and a band that spans
several ranges adds what lies in the ranges before. So neither a long conversation nor a
band without turn numbers is gathered in one task. Speakers meet turns by a join on the
conversation, which AQE splits where one holds very many rows.

Order: turn, then role, then text; rows without a turn number come last, in a band of
their own (null). Rows that repeat are rendered each time. A null or empty role is the
speaker ``unknown``; a null text is empty. Rows with a null conversation belong to none
and are rendered as conversation null. A conversation of context rows alone has no speaker
and no rendering. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.session import stage

TURNS = 64
CONTEXT = ("system", "tool")
UNKNOWN = "unknown"
END = "<|end|>"


def rendered(turns: DataFrame) -> DataFrame:
    """``conv_id, perspective, band, part, n_turns, text, mask``; ``mask`` is an array of spans."""
    role = F.when(F.coalesce("role", F.lit("")) == "", UNKNOWN).otherwise(F.col("role"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("speaker"),
        F.coalesce("text", F.lit("")).alias("said"),
    ).withColumn("band", F.floor(F.col("turn") / TURNS))
    placed = _placed(rows).withColumn("part", F.floor((F.col("place") - 1) / TURNS))
    # Few short rows: the speakers of each conversation, combined before the shuffle.
    speakers = rows.where(~F.col("speaker").isin(*CONTEXT)).select(
        F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")
    ).distinct()
    seen = placed.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
    mine = F.col("speaker") == F.col("perspective")
    head = (
        F.when(mine, F.lit("<|assistant|>"))
        .when(F.col("speaker").isin(*CONTEXT), F.concat(F.lit("<|"), "speaker", F.lit("|>")))
        .otherwise(F.concat(F.lit("<|user|>"), "speaker", F.lit(": ")))
    )
    piece = F.struct("place", head.alias("head"), F.concat("said", F.lit(END)).alias("body"), mine.alias("mine"))
    parts = seen.groupBy("conv_id", "perspective", "band", "part").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return parts.select(
        "conv_id", "perspective", "band", "part",
        F.size("pieces").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        _mask(F.col("pieces")).alias("mask"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: their number within conversation and band, from 1."""
    columns = ["conv_id", "band", "turn", "speaker", "said"]
    # Equal rows are one with a count, so no value fills a range by itself.
    counted = rows.groupBy(*columns).agg(F.count("*").alias("copies"))
    ranged = stage(
        counted.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
        "ordered_turns",
    )
    band = ["conv_id", "band"]
    inside = ranged.groupBy(*band, "range").agg(F.sum("copies").alias("inside"))
    # Only the last band of a range goes on in the next one: at most two rows a range.
    before = Window.partitionBy(*band).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inside.withColumn("ahead", F.sum("inside").over(before)).where("ahead IS NOT NULL").select(
        F.col("conv_id").alias("of"), F.col("band").alias("in"), F.col("range").alias("on"), "ahead"
    )
    until = Window.partitionBy(*band, "range").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("within", F.sum("copies").over(until)).join(
        F.broadcast(offsets),
        (F.col("range") == F.col("on")) & F.col("conv_id").eqNullSafe(F.col("of")) & F.col("band").eqNullSafe(F.col("in")),
        "left",
    )
    last = F.coalesce("ahead", F.lit(0)) + F.col("within")
    return summed.withColumn("place", F.explode(F.sequence(last - F.col("copies") + 1, last))).select(*columns, "place")


def _mask(pieces: Column) -> Column:
    """Spans of the assistant's pieces, from running lengths."""
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, stop: INT>>)")

    def add(state, p):
        start = state["at"] + F.char_length(p["head"])
        stop = start + F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + 1).alias("at"), F.when(p["mine"], F.concat(state["out"], span)).otherwise(state["out"]).alias("out")
        )

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda s: s["out"])
