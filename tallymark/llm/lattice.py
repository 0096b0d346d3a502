"""Near-duplicate vectors by E8 lattice hashing (operator 6).

Each table projects unit vectors to eight dimensions by a random matrix and decodes the
result to the nearest point of the E8 lattice, the densest packing there. A vector is
indexed in its own cell and looks into its own and the ``PROBES`` nearest of the 240
neighbouring cells. Cells carry vectors as one byte per dimension; what meets in a cell,
within one label and dimension, is kept if its cosine can reach the limit, given the most
that rounding to bytes can have changed. Whole vectors then decide each pair once, by
cosine in double precision.

Equal vectors of a label are one class with a count, so copies are never paired. Cells
with more than ``BLOCK`` vectors on a side are cut into blocks, and every pair of blocks
is a task of its own: no cell is too large for one task and none of its pairs is lost.

Vectors that are null, empty, zero, or hold null or non-finite numbers, and vectors
without a label, link with nothing. A null ``vec_id`` never links. Rows that share a
``vec_id`` are one node. ``n_links`` counts rows linked directly, a row's equals
included.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.bytehash import mix
from tallymark.llm.components import components
from tallymark.session import stage

COSINE = 0.93
TABLES = 6
PROBES = 6
#: Lattice units of a projected unit vector's spread in each dimension.
SCALE = 0.9
BLOCK = 2_048
SEED = 20_240

CELL_SCHEMA = "node BIGINT, label STRING, width INT, cell BIGINT, indexed BOOLEAN, code BINARY, grain DOUBLE"
PAIR_SCHEMA = "a BIGINT, b BIGINT"


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    error = x[odd] - point[odd]
    worst = np.abs(error).argmax(axis=1)
    # The coordinate furthest from its integer moves to the next one on its other side.
    point[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1, -1)
    return point


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: even integer points, or those shifted by one half."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def shortest_vectors() -> np.ndarray:
    """The 240 lattice vectors of least length, from a point to its neighbours."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            vector = np.zeros(8)
            vector[i], vector[j] = a, b
            found.append(vector)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _cell_ids(points: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit number per lattice point and table."""
    doubled = (2 * points).astype(np.int64).view(np.uint64)
    value = np.full(len(points), table + 1, np.uint64)
    for k in range(8):
        value = mix(value + doubled[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return value


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector its own cells ``[n, TABLES]`` and all it looks into."""
    neighbours, own, probed = shortest_vectors(), [], []
    for table in range(TABLES):
        matrix = np.random.default_rng([SEED, table, unit.shape[1]]).standard_normal((unit.shape[1], 8))
        place = unit @ matrix * SCALE
        point = nearest_point(place)
        own.append(_cell_ids(point, table))
        near = np.argpartition(-((place - point) @ neighbours.T), PROBES, axis=1)[:, :PROBES]
        probed.append(own[-1])
        probed += [_cell_ids(point + neighbours[near[:, k]], table) for k in range(PROBES)]
    return np.stack(own, axis=1), np.stack(probed, axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _cell_batches(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        widths = np.asarray(table.column("width"))
        for width in np.unique(widths):
            rows = table.filter(pa.array(widths == width)).combine_chunks()
            unit = _unit(_matrix(rows.column("vector").combine_chunks(), int(width)))
            own, probed = cells(unit)
            both = np.concatenate([own, probed], axis=1)
            grain = np.abs(unit).max(axis=1) / 127
            codes = pa.array([c.tobytes() for c in np.rint(unit / grain[:, None]).astype(np.int8)], pa.binary())
            take = np.repeat(np.arange(len(unit)), both.shape[1])
            indexed = np.tile(np.arange(both.shape[1]) < own.shape[1], len(unit))
            for low in range(0, len(take), 20_000):
                part = pa.array(take[low : low + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("node").combine_chunks().take(part),
                        rows.column("label").combine_chunks().take(part),
                        rows.column("width").combine_chunks().take(part),
                        pa.array(both.reshape(-1)[low : low + 20_000].view(np.int64)),
                        pa.array(indexed[low : low + 20_000]),
                        codes.take(part),
                        pa.array(grain).take(part),
                    ],
                    ["node", "label", "width", "cell", "indexed", "code", "grain"],
                )


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """Pairs of a block of indexed and a block of looking vectors whose cosine may suffice.

    A rounded vector is off by half a grain per dimension at most, hence the slack.
    """
    node = np.asarray(table.column("node"))
    indexed = np.asarray(table.column("indexed"))
    grain = np.asarray(table.column("grain"))
    width = int(table.column("width")[0].as_py())
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(-1, width)
    rounded = codes.astype(np.float32) * grain[:, None].astype(np.float32)
    slack = grain / 2 * np.sqrt(width) + 1e-5
    one, two = np.flatnonzero(indexed), np.flatnonzero(~indexed)
    found: list[np.ndarray] = []
    for low in range(0, len(one), 512):
        part = one[low : low + 512]
        most = slack[part][:, None] + slack[two] + slack[part][:, None] * slack[two]
        i, j = np.nonzero(rounded[part] @ rounded[two].T >= COSINE - most)
        a, b = node[part[i]], node[two[j]]
        pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b]
        found.append(np.unique(pairs, axis=0))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _scaled(vector: Column) -> Column:
    """The vector with its largest component at one, so that no square overflows."""
    top = F.array_max(F.transform(vector, F.abs))
    return F.transform(vector, lambda v: v / top)


def linked_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
        & F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
        & F.expr("exists(vector, x -> x <> 0)")
    )
    rows = stage(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    # Equal vectors are one class; minus zero counts as zero.
    plain = rows.where("sound").select("vec_id", "label", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    marked = plain.select("vec_id", "label", F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256).alias("mark"), "vector")
    classes = stage(
        marked.groupBy("label", "mark").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("copies"), _scaled(F.first("vector")).alias("vector")
        ),
        "vector_classes",
    )
    placed = classes.select("node", "label", F.size("vector").alias("width"), "vector").repartition(
        F.xxhash64("node")
    ).mapInArrow(_cell_batches, CELL_SCHEMA)
    placed = stage(placed, "vector_cells")
    key = ["label", "width", "cell"]
    # Cells in which someone looks and someone else is indexed.
    crowded = placed.groupBy(*key).agg(
        F.count_if("indexed").alias("i"), F.count_if(~F.col("indexed")).alias("l")
    ).where("i > 0 AND l > 1").select(*key, F.ceil(F.col("i") / BLOCK).alias("bi"), F.ceil(F.col("l") / BLOCK).alias("bl"))
    met = placed.join(crowded, key)
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("indexed"), F.col("bi")).otherwise(F.col("bl")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("indexed"), F.col("bl")).otherwise(F.col("bi")) - 1))
    dealt = met.withColumn("own", part).withColumn("other", others).select(
        *key, "node", "indexed", "code", "grain",
        F.when(F.col("indexed"), F.col("own")).otherwise(F.col("other")).alias("x"),
        F.when(F.col("indexed"), F.col("other")).otherwise(F.col("own")).alias("y"),
    )
    maybe = dealt.groupBy(*key, "x", "y").applyInArrow(_meet, PAIR_SCHEMA).distinct()
    whole = classes.select("node", "vector")
    pairs = (
        maybe.join(whole.select(F.col("node").alias("a"), F.col("vector").alias("va")), "a")
        .join(whole.select(F.col("node").alias("b"), F.col("vector").alias("vb")), "b")
        .where(cosine(F.col("va"), F.col("vb")) >= COSINE).select("a", "b")
    )
    pairs = stage(pairs, "vector_links")
    return _report(rows, marked, classes, pairs)


def _report(rows: DataFrame, marked: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    copies = classes.select("node", "copies")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = (
        both.join(copies.withColumnRenamed("node", "b"), "b")
        .groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("linked"))
    )
    named = marked.select("vec_id", "label", "mark").join(classes.select("label", "mark", "node", "copies"), ["label", "mark"])
    inside = named.select(F.col("vec_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    labels = components(pairs.union(inside))
    counted = (
        named.join(beside, "node", "left")
        .groupBy("vec_id").agg(F.max(F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"))
    )
    return (
        rows.select("vec_id")
        .join(counted, "vec_id", "left")
        .join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
