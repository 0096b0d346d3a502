"""Mixing sources to target weights (operator 3).

Targets are shares of a total by weight, filled up to a cap of ``CAP`` times a source's
own size; what a capped source leaves is shared again by weight. With sources sorted by
cap per weight the capped ones come first, so one running sum gives the level at which
the rest are filled.

Within a source documents are drawn by Efraimidis-Spirakis keys, -ln(u) / quality,
smallest first, with u a hash of the document's id: better documents tend to come
early, and a rerun draws the same. A target first takes complete epochs of its source;
the remainder takes the documents in key order whose midpoint of the running sum lies
within it, which ends at most half a document away from the target.

The running sum needs no source in one task: keys fall into key ranges, sums of ranges
are added up, and each range adds its own documents to what came before. A source with a
third of all rows has a third of the ranges. Ranges are equal slices of e^(-key * w), w
the least weight; a document weighing more falls into a slice at most its weight over w
times as often, so a range expects at most four times ``RANGE_ROWS`` documents. A document
without an id draws by its text.

A null source is a source of its own, last in order. Null and empty texts have size 0 and
are taken 0 words. Equal rows draw equal keys and stand next to each other. Extra columns
of ``docs`` are ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.session import stage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the sources.
TOTAL = 1.5
CAP = 2
#: Expected documents of one key range.
RANGE_ROWS = 2_000
#: Quality weights of documents by label: labelled good, labelled bad, unlabelled.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}


def size_in_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t\\n\\v\\f\\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def quality(labels: DataFrame) -> DataFrame:
    """``doc_id, quality``: one weight per labelled document."""
    best = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    return best.select(
        "doc_id",
        F.when(F.col("label") == 1, QUALITY[1]).when(F.col("label") == 0, QUALITY[0]).otherwise(QUALITY[None]).alias("quality"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, documents, target`` from ``source, source_size, documents``.

    The windows run over one row per source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), turn.cast("int") + 1)
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(CAP))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everyone) * TOTAL - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    found = weighed.withColumn("level", level)
    # The first source not filled to its cap sets the level for itself and all after it;
    # there the level is highest among the open ones.
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everyone)
    first_open = F.min(
        F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))
    ).over(everyone)
    target = F.when(F.col("cap") / F.col("weight") < first_open, F.col("cap")).otherwise(
        F.least("cap", open_level * F.col("weight"))
    )
    return found.withColumn("target", target).select("source", "source_size", "documents", "target")


def _uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the digest of the id, or else of the text; the same in every run."""
    named = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double")
    return (number + 0.5) / float(1 << 52)


def plan(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``doc_id, mark, size, source, source_size, target, taken`` for every row of ``docs``.

    ``weights(doc_id, quality)`` has at most one row per document; others weigh 1.
    ``mark`` tells texts of one id apart.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("mark"),
        F.col("source").cast("string").alias("source"),
        size_in_words(F.col("text")).alias("size"),
        _uniform(F.col("doc_id"), F.col("text")).alias("draw"),
    )
    if weights is not None:
        sized = sized.join(weights, "doc_id", "left")
        weight = F.coalesce("quality", F.lit(QUALITY[None]))
    else:
        weight = F.lit(QUALITY[None])
    keyed = stage(
        sized.withColumn("key", -F.log("draw") / weight).select("doc_id", "mark", "source", "size", "key"),
        "mix_sizes",
    )
    wanted = targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")))
    # 1 - e^(-key * w) grows with the key and lies in (0, 1): equal slices of it are key ranges.
    least = min(QUALITY.values())
    slices = F.ceil(F.col("documents") / RANGE_ROWS)
    placed = (
        keyed.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("slice", F.floor((1 - F.exp(-F.col("key") * least)) * slices))
        .select("doc_id", "mark", "source", "size", "key", "slice", "source_size", "target")
    )
    placed = stage(placed, "mix_slices")
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("inside"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("of"), F.col("slice").alias("in"),
        F.coalesce(F.sum("inside").over(ahead), F.lit(0)).alias("ahead"),
    )
    ordered = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "mark").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = placed.withColumn("within", F.sum("size").over(ordered)).join(
        offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in"))
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    fraction = F.when(F.col("ahead") + F.col("within") - F.col("size") / 2 <= rest, 1).otherwise(0)
    return summed.select(
        "doc_id", "mark", "size", "source", "source_size", "target",
        (F.col("size") * F.when(epochs >= CAP, F.lit(CAP)).otherwise(epochs + fraction)).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows of the mix: a document once for each time it is taken, with all its columns."""
    times = plan(docs, weights).where("taken > 0").select(
        F.col("doc_id"), F.col("mark"), F.col("source"), (F.col("taken") / F.col("size")).cast("int").alias("times")
    ).dropDuplicates(["doc_id", "mark", "source"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(
        times,
        F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id"))
        & (F.xxhash64("row.text") == F.col("mark"))
        & F.col("row.source").cast("string").eqNullSafe(F.col("source")),
    )
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
