"""Near-duplicate documents by HyperMinHash sketches (operator 4).

Every document becomes the set of its distinct five-word shingles (hashed to 64 bits).
One hash per shingle gives its bucket and its value there; a bucket's register keeps
the smallest value as a leading-zero count and a few mantissa bits. Registers in bands
make candidates, the share of equal registers, corrected for chance collisions,
discards most of them, and full shingle sets decide the rest.

How hot groups are kept whole without pairing everything with everything:

* Documents with equal sets form one class; one representative stands for it.
* In each bucket of candidates everyone is first compared with one centre, the member
  that shares most buckets with others. What links joins a component.
* Only members of *different* components in the same bucket are then compared in
  pairs. Estimate and verification are part of the join, so none but links are produced.
  Links between members of one component would not change it.

Sets below ``SMALL`` leave too many registers empty for bands. They use their rarest
shingles as keys instead: of two sets with a similarity of 0.75, ordered by how many sets
hold each shingle, the first quarters (and one more) must meet, so every pair is found,
and a line that many short documents share is not what brings them together.

Rows without words are linked with nothing. A row with a null ``doc_id`` passes
unlinked. Rows that share a ``doc_id`` are one node, linked if any of its texts is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.bytehash import Powers, lower_ascii, mix, row_chunks, utf8, word_hashes
from tallymark.llm.components import components
from tallymark.session import stage

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BUCKET_BITS = 6
REGISTERS = 1 << BUCKET_BITS
MANTISSA_BITS = 4
MAX_ZEROS = 15
BAND = 4
SMALL = 96
#: Chance that registers of unrelated buckets agree, for 4 mantissa bits.
COLLISION = 0.0212
#: Estimates up to so many standard errors below the limit still go to verification.
ERRORS = 5
#: Bytes of text sketched at once; few, as sets and sketches take many times their text.
BLOCK_BYTES = 1 << 18

SKETCH_SCHEMA = (
    "doc_id BIGINT, n_shingles BIGINT, f1 BIGINT, f2 BIGINT, filled BIGINT, sketch ARRAY<INT>, "
    "bands ARRAY<BIGINT>, small ARRAY<BIGINT>"
)


# --- sets and sketches, vectorised over a block of documents ------------------------


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin."""
    counts = np.diff(first)
    width = np.minimum(counts, WORDS)
    per_row = np.where(counts > 0, counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), per_row)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    at = first[row] + offset
    value = np.zeros(len(row), np.uint64)
    for k in range(WORDS):
        use = width[row] > k
        value[use] = mix(value[use] + words[at[use] + k] + np.uint64(k + 1))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def registers(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One byte per bucket and row: 0 if empty, else zeros count and mantissa of its minimum."""
    rows = len(first) - 1
    out = np.zeros((rows, REGISTERS), np.uint8)
    row = np.repeat(np.arange(rows), np.diff(first))
    bucket = (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    lowest = np.ones(len(value), bool)
    lowest[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    rest = (value[lowest] << np.uint64(BUCKET_BITS)) | np.uint64(1)
    zeros = np.minimum(63 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64), MAX_ZEROS)
    zeros = np.clip(zeros, 0, MAX_ZEROS - 1)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out[row[lowest], bucket[lowest]] = ((zeros + 1) << MANTISSA_BITS) | mantissa.astype(np.int64)
    return out


def _band_keys(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands of all rows, and which bands are not empty.

    Two partitions of the registers into bands of four: neighbours, and equal strides.
    """
    neighbours = sketch.reshape(len(sketch), -1, BAND)
    strided = sketch.reshape(len(sketch), BAND, -1).transpose(0, 2, 1)
    bands = np.ascontiguousarray(np.concatenate([neighbours, strided], axis=1))
    packed = bands.view("<u4")[:, :, 0].astype(np.uint64)
    number = np.arange(packed.shape[1], dtype=np.uint64) + np.uint64(1)
    return mix(packed | (number << np.uint64(32))), packed != 0


def _sketch_block(words: np.ndarray, first: np.ndarray):
    value, begins = shingles(words, first)
    sizes = np.diff(begins)
    rows = np.flatnonzero(sizes)
    sketch = registers(value, begins)
    band, filled = _band_keys(sketch)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value), dtype=np.uint64)])
    f1, f2 = sums[begins[1:]] - sums[begins[:-1]], mixed[begins[1:]] - mixed[begins[:-1]]
    none = np.empty(0, np.uint64)
    bands, small = [none] * len(sizes), [none] * len(sizes)
    for i in rows:
        size = int(sizes[i])
        if size >= SMALL:
            bands[i] = band[i][filled[i]]
        # A set this small may be linked with one below SMALL.
        if PERCENT * size < 100 * SMALL:
            small[i] = value[begins[i] : begins[i + 1]]
    return sizes, f1, f2, sketch, bands, small


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _packed(sketch: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A bit per filled bucket, and the filled registers, each with its bucket's number."""
    filled = sketch != 0
    bits = np.packbits(filled, axis=1, bitorder="little").view(np.int64)[:, 0]
    row, bucket = np.nonzero(filled)
    offsets = np.searchsorted(row, np.arange(len(sketch) + 1)).astype(np.int32)
    named = (bucket << 8 | sketch[row, bucket]).astype(np.int32)
    return pa.array(bits), pa.ListArray.from_arrays(pa.array(offsets), pa.array(named))


def _sketch_batches(batches):
    powers = Powers()
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for low, high in row_chunks(bounds, BLOCK_BYTES):
            own = bounds[low : high + 1] - bounds[low]
            words, first = word_hashes(lower_ascii(data[bounds[low] : bounds[high]]), own, powers)
            sizes, f1, f2, sketch, bands, small = _sketch_block(words, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(f1.view(np.int64)),
                    pa.array(f2.view(np.int64)),
                    *_packed(sketch),
                    _lists(bands),
                    _lists(small),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "filled", "sketch", "bands", "small"],
            )


def _set_batches(batches):
    powers = Powers()
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for low, high in row_chunks(bounds, BLOCK_BYTES):
            own = bounds[low : high + 1] - bounds[low]
            words, first = word_hashes(lower_ascii(data[bounds[low] : bounds[high]]), own, powers)
            value, begins = shingles(words, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(value.view(np.int64))),
                ],
                ["node", "shingles"],
            )


# --- estimates and verification as column expressions -------------------------------


def plausible(a: str, b: str) -> Column:
    """Whether the collision-corrected estimate of two sketches leaves a link possible.

    Of the buckets filled on either side, a share J + (1 - J) * COLLISION agrees.
    """
    agree = F.size(F.array_intersect(f"{a}.sketch", f"{b}.sketch"))
    filled = F.bit_count(F.col(f"{a}.filled").bitwiseOR(F.col(f"{b}.filled")))
    share = PERCENT / 100 + (1 - PERCENT / 100) * COLLISION
    slack = ERRORS * (share * (1 - share)) ** 0.5
    return agree >= filled * share - F.sqrt(filled) * slack


def _sizes_fit(a: str, b: str) -> Column:
    low, high = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")), F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return low * 100 >= high * PERCENT


def _held_elsewhere(sets: DataFrame, sketches: DataFrame, undecided: DataFrame) -> DataFrame:
    """``sketches`` with ``held``: those shingles of a set that some other undecided set holds, too.

    Two sets share what they share within these. Most undecided documents only have a
    passage in common with others, and edits leave shingles that nobody else has, so
    these parts are short. Sets that hold too few of them for any link are left out.
    """
    loose = sets.join(undecided.select("node").distinct(), "node", "left_semi").select(
        "node", F.explode("shingles").alias("h")
    )
    common = loose.groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1")
    held = loose.join(common.select("h"), "h", "left_semi").groupBy("node").agg(F.collect_list("h").alias("held"))
    return held.join(sketches, "node").where(F.size("held") * 100 >= F.col("n") * PERCENT)


def _held_similar(a: str, b: str) -> Column:
    """Whether two sets are similar enough, by the shingles that matter; exact."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    most = F.least(F.size(f"{a}.held"), F.size(f"{b}.held"))
    common = F.size(F.array_intersect(f"{a}.held", f"{b}.held"))
    return (most * 100 >= (total - most) * PERCENT) & plausible(a, b) & (common * 100 >= (total - common) * PERCENT)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return joined.where(common * 100 >= union * PERCENT).select("a", "b")


# --- the operator --------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stage(texts.mapInArrow(_sketch_batches, SKETCH_SCHEMA), "sketches")
    known = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    # One class for each distinct set; its smallest document stands for it.
    classes = stage(
        known.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(
            F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("filled", "sketch", "bands", "small"))
        ),
        "classes",
    )
    pairs = _links(texts, classes)
    grouped = known.select("doc_id", "f1", "f2", F.col("n_shingles").alias("n")).join(
        classes.select("f1", "f2", "n", "node"), ["f1", "f2", "n"]
    )
    # A class links its documents; so do equal doc_ids.
    inside = grouped.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    labels = components(pairs.union(inside))
    return (
        sketched.select("doc_id", "n_shingles")
        .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def _rarest(classes: DataFrame) -> DataFrame:
    """``node, n, key``: the rarest shingles of small sets, enough to meet every similar set."""
    held = stage(classes.select("node", "n", F.explode("small").alias("key")), "small_sets")
    counts = held.groupBy("key").agg(F.count("*").alias("sets"))
    ranked = held.join(counts, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "key"))).alias("by"))
    enough = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return ranked.select("node", "n", F.explode(F.slice("by", F.lit(1), enough.cast("int"))).alias("k")).select("node", "n", "k.key")


def _links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links between classes that fix the components of all."""
    keys = classes.select("node", "n", F.explode("bands").alias("key")).union(_rarest(classes))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    keys = stage(keys.join(shared, "key"), "candidate_keys")
    # The centre of a bucket: the member that meets most others over all its buckets.
    meets = keys.groupBy("node").agg(F.sum("members").alias("meets"))
    named = keys.join(meets, "node")
    centres = named.groupBy("key").agg(
        F.max(F.struct("meets", -F.col("node"))).alias("top")
    ).select("key", (-F.col("top.col2")).alias("centre"))
    sketches = stage(
        classes.join(meets.select("node"), "node", "left_semi").select("node", "n", "filled", "sketch"), "candidate_sketches"
    )
    starred = (
        keys.join(centres, "key").where("node <> centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    )
    first = (
        starred.join(sketches.select(F.col("node").alias("a"), F.struct("n", "filled", "sketch").alias("x")), "a")
        .join(sketches.select(F.col("node").alias("b"), F.struct("n", "filled", "sketch").alias("y")), "b")
        .where(_sizes_fit("x", "y") & plausible("x", "y"))
        .select("a", "b")
    )
    sets = stage(
        texts.join(meets.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(
            _set_batches, "node BIGINT, shingles ARRAY<BIGINT>"
        ),
        "shingle_sets",
    )
    links = stage(verified(first, sets), "links_to_centres")
    # Members of different components that still share a bucket.
    labels = components(links)
    placed = (
        keys.join(labels, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component"))
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    undecided = placed.join(mixed.select("key"), "key", "left_semi")
    # Read once for both sides of the join that follows, so it is not written.
    open_keys = undecided.join(stage(_held_elsewhere(sets, sketches, undecided), "undecided_sets"), "node")
    rest = open_keys.alias("x").join(
        open_keys.alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.component") != F.col("y.component"))
        & _sizes_fit("x", "y")
        & _held_similar("x", "y"),
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return links.union(stage(rest.distinct(), "links_between"))
