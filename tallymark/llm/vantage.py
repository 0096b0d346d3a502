"""Nearest neighbours by vantage-point trees in shards (operator 13).

A vantage-point tree splits vectors by their distance to one of them, at the median. A
vector x in a part whose distances to the vantage point lie in [low, high] is, by the
triangle inequality, at least ``low - d`` and ``d - high`` from a query at distance d.
A part is passed over if that bound times ``factor`` exceeds the query's distance to its
k-th best so far. Factor one never passes over a neighbour; larger ones skip more.

1. *Cells.* The same split, ``DEPTH`` levels deep, is fitted on a sample of about
   ``SAMPLE`` vectors and deals all vectors into at most ``2**DEPTH`` cells, whatever
   their number. A cell is dealt evenly into shards of at most ``SHARD_BYTES``, so no cell
   is too large for a task, and each shard gets a tree, written once.
2. *Home.* A query first searches the shards of its own cell; its k-th best distance
   there limits all further search.
3. *Others.* It is then sent to those other cells that its limit cannot exclude. Queries
   meet a shard in blocks of at most ``QUERY_BYTES``, all walking its tree together.

Distances are Euclidean, in double precision; ties go to the smaller ``vec_id``. Only
vectors of equal dimension are compared; those of a dimension the sample lacks form one
cell. Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without ``vec_id``. Every other row is a candidate of its own; those
with a query's ``vec_id`` are not its neighbours. Equal rows ask once; different vectors
under one id ask separately, each with ranks from 1. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import stage

K = 10
#: How much stricter than the triangle inequality parts are passed over; one is exact.
FACTOR = 2.0
DEPTH = 6
#: Vectors on which cells are fitted, and their bytes at most.
SAMPLE = 8_192
SAMPLE_BYTES = 1 << 26
SHARD_BYTES = 1 << 24
QUERY_BYTES = 1 << 22
LEAF = 48
#: Numbers in one block of differences.
BLOCK_ENTRIES = 1 << 20
SEED = 13

PLACED_SCHEMA = "vec_id BIGINT, width INT, cell INT, vector ARRAY<DOUBLE>"
TREE_SCHEMA = (
    "width INT, cell INT, part BIGINT, ids ARRAY<BIGINT>, vectors BINARY, nodes ARRAY<INT>, reaches ARRAY<DOUBLE>"
)
FOUND_SCHEMA = "query BIGINT, query_id BIGINT, ids ARRAY<BIGINT>, scores ARRAY<DOUBLE>"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``, by differences: nothing cancels."""
    out = np.empty((len(a), len(b)))
    step = max(1, BLOCK_ENTRIES // max(1, b.size))
    for low in range(0, len(a), step):
        away = a[low : low + step, None, :] - b[None, :, :]
        # Scaled where squares would overflow or vanish.
        top = np.abs(away).max(initial=0.0)
        scale = 1.0 if 1e-140 < top < 1e140 else max(top, np.finfo(float).tiny)
        away = away / scale if scale != 1.0 else away
        out[low : low + step] = np.sqrt((away * away).sum(axis=2)) * scale
    return out


def vantage_of(vectors: np.ndarray, random: np.random.Generator) -> int:
    """The vector farthest from a random one: from the rim distances spread widest."""
    return int(distances(vectors[[random.integers(len(vectors))]], vectors)[0].argmax())


# --- cells ----------------------------------------------------------------------------


@dataclass
class Cells:
    """A vantage-point tree over the sample; its leaves are the cells."""

    vantage: np.ndarray
    radius: np.ndarray
    #: Per node the inner and outer child; a cell is its number's complement.
    child: np.ndarray
    count: int

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int = DEPTH) -> Cells:
        random = np.random.default_rng([SEED, sample.shape[1]])
        vantage, radius, child, count = [], [], [], 0

        def grow(rows: np.ndarray, level: int) -> int:
            nonlocal count
            if level < depth and len(rows) >= 2:
                point = rows[vantage_of(sample[rows], random)]
                away = distances(sample[[point]], sample[rows])[0]
                middle = float(np.median(away))
                inner = away <= middle
                if not inner.all():
                    node = len(radius)
                    vantage.append(sample[point]), radius.append(middle), child.append([0, 0])
                    child[node] = [grow(rows[inner], level + 1), grow(rows[~inner], level + 1)]
                    return node
            count += 1
            return ~(count - 1)

        grow(np.arange(len(sample)), 0)
        return cls(np.array(vantage).reshape(len(radius), sample.shape[1]), np.array(radius), np.array(child, int).reshape(-1, 2), count)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        node = np.zeros(len(vectors), np.int64) if len(self.radius) else np.full(len(vectors), -1)
        while (live := np.flatnonzero(node >= 0)).size:
            for k in np.unique(node[live]):
                at = live[node[live] == k]
                away = distances(self.vantage[[k]], vectors[at])[0]
                node[at] = np.where(away <= self.radius[k], *self.child[k])
        return ~node

    def within(self, vectors: np.ndarray, limit: np.ndarray, factor: float) -> np.ndarray:
        """Which cells ``[n, count]`` may hold something within each vector's limit."""
        out = np.zeros((len(vectors), self.count), bool)
        waiting = [(0 if len(self.radius) else -1, np.arange(len(vectors)))]
        while waiting:
            node, at = waiting.pop()
            if node < 0:
                out[at, ~node] = True
                continue
            away = distances(self.vantage[[node]], vectors[at])[0]
            for child, bound in zip(self.child[node], (away - self.radius[node], self.radius[node] - away)):
                waiting.append((int(child), at[~excluded(bound, away, limit[at], factor)]))
        return out


def excluded(bound: np.ndarray, away: np.ndarray, limit: np.ndarray, factor: float) -> np.ndarray:
    """Whether a lower bound of distances rules a part out; rounding never does."""
    with np.errstate(invalid="ignore"):
        return bound * factor > limit + 1e-12 * (away + limit)


# --- trees of shards ------------------------------------------------------------------


@dataclass
class Tree:
    """Vectors in tree order. A node owns a slice: its vantage point, inner part, outer part.

    ``nodes`` holds ``begin, outer begin, end, inner child, outer child`` per node, with
    children -1 at leaves; ``reaches`` the least and greatest distance of either part.
    """

    ids: np.ndarray
    vectors: np.ndarray
    nodes: np.ndarray
    reaches: np.ndarray

    @classmethod
    def grow(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        random = np.random.default_rng(SEED)
        order, nodes, reaches = np.lexsort((ids,)), [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            begin, end, parent, side = waiting.pop()
            node = len(nodes)
            nodes.append([begin, end, end, -1, -1]), reaches.append([0.0] * 4)
            if parent >= 0:
                nodes[parent][3 + side] = node
            if end - begin <= LEAF:
                continue
            rows = order[begin:end]
            first = vantage_of(vectors[rows], random)
            rows[0], rows[first] = rows[first], rows[0]
            away = distances(vectors[rows[:1]], vectors[rows[1:]])[0]
            sort = np.argsort(away, kind="stable")
            rows[1:] = rows[1:][sort]
            away, half = away[sort], (end - begin) // 2
            reaches[node] = [away[0], away[half - 1], away[half], away[-1]]
            nodes[node][1] = begin + 1 + half
            waiting += [(begin + 1, begin + 1 + half, node, 0), (begin + 1 + half, end, node, 1)]
        return cls(ids[order], vectors[order], np.array(nodes).reshape(-1, 5), np.array(reaches).reshape(-1, 4))

    def search(self, queries: np.ndarray, own: np.ndarray, limit: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest ids and distances of each query, infinite where there are fewer.

        ``own`` is the id that is no neighbour; only distances up to ``limit`` count.
        """
        state = _Best(len(queries), k, limit)
        # Down to one leaf by the nearer side first, for a limit to start from.
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, at = waiting.pop()
            begin, _, end, inner, outer = self.nodes[node]
            if inner < 0:
                self._take(state, begin, end, queries, own, at)
                continue
            away = distances(self.vectors[[begin]], queries[at])[0]
            near = away * 2 <= self.reaches[node, 1] + self.reaches[node, 2]
            waiting += [(int(c), a) for c, a in ((inner, at[near]), (outer, at[~near])) if len(a)]
        state.start_over()
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, at = waiting.pop()
            begin, _, end, inner, outer = self.nodes[node]
            if inner < 0:
                self._take(state, begin, end, queries, own, at)
                continue
            away = self._take(state, begin, begin + 1, queries, own, at)
            for child, low, high in ((outer, *self.reaches[node, 2:]), (inner, *self.reaches[node, :2])):
                out = excluded(np.maximum(low - away, away - high), away, state.limit[at], factor)
                if not out.all():
                    waiting.append((int(child), at[~out]))
        return state.ids, state.scores

    def _take(self, state: _Best, begin: int, end: int, queries: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        away = distances(queries[at], self.vectors[begin:end])
        ids = self.ids[begin:end]
        state.add(at, ids, np.where(ids == own[at, None], np.inf, away))
        return away[:, 0]


class _Best:
    """The best of each query so far, and the distance beyond which nothing counts."""

    def __init__(self, count: int, k: int, limit: np.ndarray) -> None:
        self._k, self.limit = k, limit.astype(np.float64)
        self._shape = (count, k)
        self.start_over()

    def start_over(self) -> None:
        """Forget what was found, not how near it was."""
        self.ids, self.scores = np.zeros(self._shape, np.int64), np.full(self._shape, np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, away: np.ndarray) -> None:
        better = (away <= self.limit[at, None]) & np.isfinite(away)
        some = better.any(axis=1)
        at, away = at[some], np.where(better, away, np.inf)[some]
        if not len(at):
            return
        scores = np.concatenate([self.scores[at], away], axis=1)
        names = np.concatenate([self.ids[at], np.broadcast_to(ids, away.shape)], axis=1)
        order = np.lexsort((names, scores), axis=1)[:, : self._k]
        self.scores[at] = scores = np.take_along_axis(scores, order, axis=1)
        self.ids[at] = np.take_along_axis(names, order, axis=1)
        self.limit[at] = np.minimum(self.limit[at], scores[:, -1])


# --- tasks ----------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, width)


def _by_width(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        widths = np.asarray(table.column("width"))
        for width in np.unique(widths):
            yield int(width), table.filter(pa.array(widths == width)).combine_chunks()


def _place_batches(models: dict[int, Cells]):
    def run(batches):
        for width, rows in _by_width(batches):
            model = models.get(width)
            cell = model.of(_matrix(rows.column("vector"), width)) if model else np.zeros(rows.num_rows)
            placed = rows.append_column("cell", pa.array(cell.astype(np.int32)))
            yield from placed.select(["vec_id", "width", "cell", "vector"]).to_batches()

    return run


def _send_batches(models: dict[int, Cells], factor: float):
    """A row for every other cell that a query has to visit."""

    def run(batches):
        for width, rows in _by_width(batches):
            if width not in models:
                continue
            vectors, home = _matrix(rows.column("vector"), width), np.asarray(rows.column("cell"))
            near = models[width].within(vectors, np.asarray(rows.column("near")), factor)
            near[np.arange(len(home)), home] = False
            row, cell = np.nonzero(near)
            for low in range(0, len(row), 10_000):
                part = rows.take(pa.array(row[low : low + 10_000]))
                at = part.schema.get_field_index("cell")
                sent = part.set_column(at, "cell", pa.array(cell[low : low + 10_000].astype(np.int32)))
                yield from sent.combine_chunks().to_batches()

    return run


def _grow_table(key: tuple, table: pa.Table) -> pa.Table:
    width, cell, part = (k.as_py() for k in key)
    tree = Tree.grow(np.asarray(table.column("vec_id")), _matrix(table.column("vector"), width))
    return pa.table(
        {
            "width": pa.array([width], pa.int32()),
            "cell": pa.array([cell], pa.int32()),
            "part": pa.array([part], pa.int64()),
            "ids": pa.array([tree.ids], pa.list_(pa.int64())),
            "vectors": pa.array([tree.vectors.tobytes()], pa.binary()),
            "nodes": pa.array([tree.nodes.reshape(-1)], pa.list_(pa.int32())),
            "reaches": pa.array([tree.reaches.reshape(-1)], pa.list_(pa.float64())),
        }
    )


def _search_tables(k: int, factor: float):
    """A shard and a block of queries: the best of each query there."""

    def run(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        empty = {"query": [], "query_id": [], "ids": [], "scores": []}
        if shard.num_rows and block.num_rows:
            width = key[0].as_py()
            flat = lambda name: np.asarray(shard.column(name).combine_chunks().flatten())
            vectors = np.frombuffer(shard.column("vectors")[0].as_py(), np.float64).reshape(-1, width)
            tree = Tree(flat("ids"), vectors, flat("nodes").reshape(-1, 5), flat("reaches").reshape(-1, 4))
            ids, scores = tree.search(
                _matrix(block.column("vector"), width), np.asarray(block.column("query_id")), np.asarray(block.column("near")), k, factor
            )
            found = np.isfinite(scores)
            hit = found.any(axis=1)
            empty = {
                "query": np.asarray(block.column("query"))[hit],
                "query_id": np.asarray(block.column("query_id"))[hit],
                "ids": [i[f] for i, f in zip(ids[hit], found[hit])],
                "scores": [s[f] for s, f in zip(scores[hit], found[hit])],
            }
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(empty.items(), kinds)})

    return run


# --- the operator ---------------------------------------------------------------------


def _fit(rows: DataFrame) -> tuple[dict[int, Cells], int]:
    """Cells per dimension from a sample by hash, and the widest dimension."""
    size = rows.agg(F.count("*").alias("n"), F.max("width").alias("widest")).first()
    if not size["n"]:
        return {}, 1
    wanted = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * size["widest"])))
    share = min(1.0, wanted / size["n"])
    drawn = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True)
    # Twice what is expected at most, should equal rows be drawn together.
    sample = rows.where(drawn).select("width", "vector").limit(2 * wanted).toArrow()
    widths = np.asarray(sample.column("width"))
    return {
        int(w): Cells.fit(_matrix(sample.filter(pa.array(widths == w)).column("vector"), int(w))) for w in np.unique(widths)
    }, size["widest"]


def nearest(vectors: DataFrame, asks: Column, k: int = K, factor: float = FACTOR) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each row where ``asks`` holds.

    ``vectors`` has ``vec_id`` and ``embedding``; ``asks`` may use ``vec_id``.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = (
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
        & F.expr("exists(vector, x -> x <> 0)")
    )
    rows = rows.where(sound).select("vec_id", F.size("vector").alias("width"), "vector")
    models, widest = _fit(rows)
    # The row number is written, so every later reading deals a row the same way.
    placed = stage(
        rows.mapInArrow(_place_batches(models), PLACED_SCHEMA).withColumn("row", F.monotonically_increasing_id()), "placed"
    )
    volume = F.count("*") * F.col("width") * 8
    parts = stage(placed.groupBy("width", "cell").agg(F.ceil(volume / SHARD_BYTES).alias("parts")), "parts")
    where = F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")
    dealt = placed.join(parts, ["width", "cell"]).select("width", "cell", where, "vec_id", "vector")
    trees = stage(dealt.groupBy("width", "cell", "part").applyInArrow(_grow_table, TREE_SCHEMA), "trees")

    queries = stage(
        placed.where(asks).groupBy("vec_id", "width", "cell", "vector").agg(F.min("row").alias("query"))
        .withColumnRenamed("vec_id", "query_id"),
        "queries",
    )
    blocks = max(1, -(-queries.count() * widest * 8 // QUERY_BYTES))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
    key = ["width", "cell", "part", "block"]
    spread = trees.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def searched(asked: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        sent = asked.join(parts, ["width", "cell"]).select("width", "cell", every, block, "query", "query_id", "vector", "near")
        found = spread.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_search_tables(k, factor), FOUND_SCHEMA)
        return found.select("query", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select(
            "query", "query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")
        )

    def best(found: DataFrame) -> DataFrame:
        nearer = Window.partitionBy("query").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(nearer)).where(F.col("rank") <= k)

    unlimited = F.lit(float("inf"))
    home = stage(best(searched(queries.withColumn("near", unlimited))).drop("rank"), "home")
    limits = home.groupBy("query").agg(F.when(F.count("*") >= k, F.max("score")).alias("near"))
    limited = queries.join(limits, "query", "left").withColumn("near", F.coalesce("near", unlimited))
    order = ["query", "query_id", "width", "cell", "vector", "near"]
    elsewhere = limited.select(*order).mapInArrow(
        _send_batches(models, factor), "query BIGINT, query_id BIGINT, width INT, cell INT, vector ARRAY<DOUBLE>, near DOUBLE"
    )
    return best(home.union(searched(elsewhere).select(*home.columns))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
