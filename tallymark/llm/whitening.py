"""Whitening of vectors by their leading principal components (operator 11).

Entries become integers, ``floor(1024 * c) + 100000``, so sums are exact. Three narrow
passes over the vectors and a small solver:

1. *Sums* of every dimension, as integers.
2. *Covariance.* Each task centres its vectors by the means and adds up their products;
   the partial matrices are summed in two steps, by matrix row and a salt, then by row.
3. *Components*, on the driver, from the one matrix, whose size depends on the dimension
   alone: Householder reflections bring it to tridiagonal form, Sturm counts bisect the
   leading eigenvalues, and inverse iteration gives their vectors, orthogonalised again
   within clusters of close eigenvalues and carried back by the reflections.
4. *Projection* with means and components broadcast; the covariance of the result is
   taken from the written projections and held against the identity.

Rows whose vector is null or holds a null or non-finite entry are dropped; zero vectors
stay. Vectors of another dimension are a fit list of their own; empty vectors have no
components and give no row. Repeated rows count as often as they stand; null ids stay.
Entries beyond ``LARGEST`` after scaling are clipped to it. A component whose eigenvalue
is zero to double precision has ``whitened`` null and takes no part in
``identity_error``, which is null if no component is left; where all variance is zero,
``explained`` is null. Each component's entry of largest magnitude is positive.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import stage

COMPONENTS = 8
GRID = 1024
SHIFT = 100_000
LARGEST = 1 << 61
#: Vectors multiplied at once in a task.
BLOCK_ENTRIES = 1 << 20
#: Groups in which the partial matrices of tasks are first summed.
SALTS = 64
#: Relative distance below which eigenvalues form a cluster.
CLUSTER = 1e-3
SEED = 11

PROJECTED_SCHEMA = "vec_id BIGINT, width INT, n BIGINT, deviation DECIMAL(38,0), whitened ARRAY<DOUBLE>"


# --- eigenvectors ---------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    rest = np.array(matrix, np.float64)
    size = len(rest)
    reflections = []
    for k in range(size - 2):
        column = rest[k + 1 :, k]
        scale = np.abs(column).max()
        vector = np.zeros(len(column))
        if scale > 0 and np.abs(column[1:]).max() > 0:
            vector = column / scale
            vector[0] += np.copysign(np.sqrt(vector @ vector), vector[0])
            vector /= np.sqrt(vector @ vector)
            part = rest[k + 1 :, k + 1 :]
            moved = part @ vector
            moved -= (vector @ moved) * vector
            part -= 2 * (np.outer(vector, moved) + np.outer(moved, vector))
            reflected = column - 2 * (vector @ column) * vector
            rest[k + 1 :, k] = rest[k, k + 1 :] = reflected
        reflections.append(vector)
    return np.diag(rest).copy(), np.diag(rest, 1).copy(), reflections


def below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each of ``at``: negative pivots of a Sturm chain."""
    tiny = np.finfo(float).tiny
    squares = np.concatenate([[0.0], beside**2])
    pivot, count = np.ones(len(at)), np.zeros(len(at), np.int64)
    with np.errstate(over="ignore"):
        for value, square in zip(diagonal, squares):
            pivot = value - at - square / pivot
            pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
            count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, beside: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until no double lies between."""
    size = len(diagonal)
    reach = np.concatenate([np.abs(beside), [0.0]]) + np.concatenate([[0.0], np.abs(beside)])
    low = np.full(wanted, (diagonal - reach).min())
    high = np.full(wanted, (diagonal + reach).max())
    margin = 4 * np.finfo(float).eps * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - margin, high + margin
    ranks = size - 1 - np.arange(wanted)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = below(diagonal, beside, middle) <= ranks
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def solve_shifted(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve ``(T - shift) y = right`` by elimination with row exchanges; no pivot below ``least``."""
    size = len(diagonal)
    main, upper, second = diagonal - shift, np.append(beside, 0.0), np.zeros(size)
    main, right = main.copy(), right.copy()
    for k in range(size - 1):
        lower = beside[k]
        if abs(main[k]) >= abs(lower):
            if abs(main[k]) < least:
                main[k] = least
            factor = lower / main[k]
            main[k + 1] -= factor * upper[k]
            right[k + 1] -= factor * right[k]
        else:
            factor = main[k] / lower
            main[k], main[k + 1], upper[k] = lower, upper[k] - factor * main[k + 1], main[k + 1]
            second[k], upper[k + 1] = upper[k + 1], -factor * upper[k + 1]
            right[k], right[k + 1] = right[k + 1], right[k] - factor * right[k + 1]
    if abs(main[-1]) < least:
        main[-1] = least
    out = np.zeros(size + 2)
    for k in range(size - 1, -1, -1):
        out[k] = (right[k] - upper[k] * out[k + 1] - second[k] * out[k + 2]) / main[k]
    return out[:size]


def leading_components(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (rows) of a symmetric matrix."""
    size = len(matrix)
    wanted = min(wanted, size)
    diagonal, beside, reflections = tridiagonal(matrix)
    norm = max(np.abs(diagonal).max(), np.abs(beside).max() if len(beside) else 0.0)
    least = max(np.finfo(float).eps * norm, np.finfo(float).tiny * 1e10)
    values = leading_eigenvalues(diagonal, beside, wanted)
    random = np.random.default_rng(SEED)
    vectors = np.zeros((wanted, size))
    first = 0
    for k in range(wanted):
        if k and values[k - 1] - values[k] > CLUSTER * norm:
            first = k
        vector = random.standard_normal(size)
        for _ in range(4):
            vector = solve_shifted(diagonal, beside, values[k], vector / np.abs(vector).max(), least)
            vector /= np.abs(vector).max()
            # Close eigenvalues pull towards the same vector; keep what is new in this one.
            for _ in range(2):
                for other in vectors[first:k]:
                    vector -= (other @ vector) * other
                vector /= np.sqrt(vector @ vector)
        vectors[k] = vector
    for k in range(len(reflections) - 1, -1, -1):
        part = vectors[:, k + 1 :]
        part -= 2 * np.outer(part @ reflections[k], reflections[k])
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    top = vectors[np.arange(wanted), np.abs(vectors).argmax(axis=1)]
    return values, vectors * np.where(top < 0, -1.0, 1.0)[:, None]


# --- passes over the vectors ----------------------------------------------------------


def grid(vectors: np.ndarray) -> np.ndarray:
    """Entries as integers."""
    return np.clip(np.floor(vectors * float(GRID)), -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT


def _blocks(batches, width: int | None = None):
    """Ids and integer vectors, some rows of one dimension at a time."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        widths = np.asarray(table.column("width"))
        for own in np.unique(widths):
            rows = table.filter(pa.array(widths == own)).combine_chunks()
            step = max(1, BLOCK_ENTRIES // int(own))
            for low in range(0, rows.num_rows, step):
                part = rows.slice(low, step).combine_chunks()
                flat = np.asarray(part.column("embedding").combine_chunks().flatten(), np.float64)
                yield part, int(own), grid(flat.reshape(-1, int(own)))


def _sum_batches(batches):
    """Per dimension the number of rows and their sum, in two parts that cannot overflow."""
    totals: dict[int, list] = {}
    for _, width, x in _blocks(batches):
        high = x >> 31
        add = [len(x), high.sum(axis=0), (x - (high << 31)).sum(axis=0)]
        totals[width] = [a + b for a, b in zip(totals[width], add)] if width in totals else add
    for width, (rows, high, low) in totals.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(width, width, np.int32)), pa.array(np.arange(width, dtype=np.int32)),
             pa.array(np.full(width, rows, np.int64)), pa.array(high), pa.array(low)],
            ["width", "i", "n", "high", "low"],
        )


def _product_batches(means: dict[int, np.ndarray]):
    def run(batches):
        products: dict[int, np.ndarray] = {}
        for _, width, x in _blocks(batches):
            centred = x - means[width]
            part = centred.T @ centred
            products[width] = products[width] + part if width in products else part
        for width, matrix in products.items():
            kind = pa.list_(pa.float64())
            for low in range(0, width, 256):
                rows = matrix[low : low + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), width, np.int32)),
                     pa.array(np.arange(low, low + len(rows), dtype=np.int32)), pa.array(list(rows), kind)],
                    ["width", "i", "sums"],
                )

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """One matrix row from those of some tasks."""
    rows = np.asarray(table.column("sums").combine_chunks().flatten()).reshape(table.num_rows, -1)
    ends = {name: pa.array([value.as_py()], pa.int32()) for name, value in zip(("width", "i"), key)}
    return pa.table({**ends, "sums": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


def _squares(x: np.ndarray, rows: int, sums: np.ndarray) -> list[Decimal]:
    """Exact sums over dimensions of ``(rows * x - sums) ** 2``."""
    reach = rows * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
    if reach**2 * x.shape[1] < 1 << 63:
        away = x * np.int64(rows) - sums.astype(np.int64)
        return [Decimal(int(v)) for v in (away * away).sum(axis=1)]
    return [Decimal(sum((rows * int(v) - int(s)) ** 2 for v, s in zip(row, sums))) for row in x]


def _projected_batches(models: dict[int, tuple]):
    def run(batches):
        for part, width, x in _blocks(batches):
            rows, sums, means, values, vectors = models[width]
            safe = np.where(values > 0, values, 1.0)
            whitened = (x - means) @ (vectors / np.sqrt(safe)[:, None]).T
            flat = pa.array(whitened.reshape(-1), mask=np.tile(values <= 0, len(x)))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(values))
            largest = Decimal(10) ** 38
            exact = [v if v < largest else None for v in _squares(x, rows, sums)]
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").combine_chunks(), part.column("width").combine_chunks(),
                 pa.array(np.full(len(x), rows, np.int64)), pa.array(exact, pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(offsets, flat)],
                ["vec_id", "width", "n", "deviation", "whitened"],
            )

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, width, embedding`` of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.expr("forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    return rows.where(finite & (F.size("embedding") > 0)).select("vec_id", F.size("embedding").alias("width"), "embedding")


def covariance(rows: DataFrame) -> dict[int, tuple]:
    """Per dimension of ``usable`` rows: their number, exact sums, means and covariance matrix."""
    sums = (
        rows.select("width", "embedding").mapInArrow(_sum_batches, "width INT, i INT, n BIGINT, high BIGINT, low BIGINT")
        .groupBy("width", "i")
        .agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
        .orderBy("width", "i").collect()
    )
    found: dict[int, tuple] = {}
    for width in sorted({r["width"] for r in sums}):
        own = [r for r in sums if r["width"] == width]
        exact = np.array([(int(r["high"]) << 31) + int(r["low"]) for r in own], object)
        found[width] = (own[0]["n"], exact, np.array([int(s) / own[0]["n"] for s in exact]))
    if not found:
        return {}
    schema = "width INT, i INT, sums ARRAY<DOUBLE>"
    partial = rows.select("width", "embedding").mapInArrow(_product_batches({w: f[2] for w, f in found.items()}), schema)
    salted = partial.withColumn("salt", F.spark_partition_id() % SALTS)
    once = salted.groupBy("width", "i", "salt").applyInArrow(_added, schema)
    matrix = once.groupBy("width", "i").applyInArrow(_added, schema).collect()
    out = {}
    for width, (rows_n, exact, means) in found.items():
        square = np.zeros((width, width))
        for r in matrix:
            if r["width"] == width:
                square[r["i"]] = r["sums"]
        out[width] = (rows_n, exact, means, (square + square.T) / 2 / rows_n)
    return out


def whitened(vectors: DataFrame) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors(vec_id, embedding)``.

    One row for each usable vector and leading component. ``deviation`` is exact, as a
    decimal, and null only where it has more than 38 digits.
    """
    rows = usable(vectors)
    spark = vectors.sparkSession
    models, shares = {}, {}
    for width, (count, sums, means, matrix) in covariance(rows).items():
        values, components = leading_components(matrix)
        trace = float(np.trace(matrix))
        # Below the rounding of the matrix itself an eigenvalue is noise.
        values = np.where(values > width * np.finfo(float).eps * values[0], values, 0.0)
        models[width] = (count, sums, means, values, components)
        shares[width] = [float(v) / trace if trace > 0 else None for v in values]
    projected = stage(rows.mapInArrow(_projected_batches(models), PROJECTED_SCHEMA), "projected")
    facts = spark.createDataFrame(
        [(w, share, error) for (w, share), error in zip(shares.items(), _identity_errors(projected, models))],
        "width INT, shares ARRAY<DOUBLE>, identity_error DOUBLE",
    )
    # One row per dimension of vectors.
    return projected.join(F.broadcast(facts), "width").select(
        "vec_id", "n", "deviation", "shares", "identity_error", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("shares", "at").alias("explained"), "identity_error",
    )


def _identity_errors(projected: DataFrame, models: dict[int, tuple]) -> list[float | None]:
    """For each dimension the largest entry by which the covariance misses the identity."""
    most = max([0, *(len(m[3]) for m in models.values())])
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    if not pairs:
        return []
    z = [F.get("whitened", F.lit(i)) for i in range(most)]
    covered = {
        r["width"]: r
        for r in projected.groupBy("width").agg(*(F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs)).collect()
    }
    out = []
    for width, model in models.items():
        live = set(np.flatnonzero(model[3] > 0).tolist())
        away = [abs(covered[width][f"c{i}_{j}"] - (i == j)) for i, j in pairs if i in live and j in live]
        out.append(reduce(max, away) if away else None)
    return out
