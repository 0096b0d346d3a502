"""Periodic runs, whitening and nearest neighbours on small tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import periodic_runs, queries, vantage, whitening

# --- operator 12 ----------------------------------------------------------------------


def plain_runs(symbols, least=24, periods=3):
    """Runs by comparing with every shift, without those that have a smaller period."""
    size, found = len(symbols), set()
    for p in range(1, size // periods + 1):
        i = 0
        while i + p < size:
            j = i
            while j + p < size and symbols[j] == symbols[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least, periods * p):
                part = symbols[i : j + p]
                if not any(part[q:] == part[: length - q] for q in range(1, p)):
                    found.add((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, periods", [(2, 2), (6, 3)])
def test_runs_of_random_symbols(least, periods):
    rng = random.Random(5)
    for _ in range(400):
        size, kinds = rng.randrange(1, 70), rng.choice([1, 2, 2, 3, 6])
        symbols = [rng.randrange(1, kinds + 1) for _ in range(size)]
        if rng.random() < 0.5:
            q, a = rng.randrange(1, 7), rng.randrange(size)
            for i in range(a + q, size):
                symbols[i] = symbols[i - q]
        assert [tuple(r) for r in periodic_runs.runs_of(symbols, least, periods).tolist()] == plain_runs(symbols, least, periods)


def test_common_extensions_over_many_blocks():
    rng = random.Random(6)
    symbols = [rng.randrange(1, 3) for _ in range(300)] * 3
    tree = periodic_runs.SuffixTree(symbols)
    pairs = np.array([rng.sample(range(900), 2) for _ in range(500)])
    for (a, b), found in zip(pairs.tolist(), tree.common_extension(pairs[:, 0], pairs[:, 1]).tolist()):
        size = 0
        while max(a, b) + size < 900 and symbols[a + size] == symbols[b + size]:
            size += 1
        assert found == size


def digests(words):
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_periodic_runs_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \t\n ", "x", "x " * 23, "x " * 24, "é\x0bü\r" * 30, "x " * 24]
    for _ in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))]
        for _ in range(rng.randrange(3)):
            q, a = rng.randrange(1, 30), rng.randrange(len(words))
            words[a:a] = words[a : a + q] * rng.randrange(2, 9)
        texts.append(rng.choice([" ", "\t", "\n "]).join(words))
    texts.append("line of words again and again\n" * 20)
    rows = [(None if i == 5 else i // 2 if i > 60 else i, t, "clash") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, runs STRING")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted(map(repr, map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect())))
    wanted, altered = [], 0
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
            altered += 1
        wanted.append(repr((doc_id, *digests(words))))
    assert altered > 3 and found == sorted(wanted)


def test_runs_in_long_texts_and_no_rows(spark):
    rng = random.Random(8)
    prose = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    phrase = [f"p{i}" for i in range(500)]
    text = " ".join(prose[:100_000] + phrase * 4 + prose[100_000:])
    frame = spark.createDataFrame([(1, text), (2, "a b " * 150_000)], "doc_id LONG, text STRING")
    one, two = periodic_runs.periodic_runs(frame).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(100_000, 2_000, 500)] and one.n_words == 202_000
    assert one.collapsed == " ".join(prose[:100_000] + phrase + prose[100_000:])
    assert [tuple(r) for r in two.runs] == [(0, 300_000, 2)] and two.collapsed == "a b"
    assert periodic_runs.periodic_runs(frame.limit(0)).count() == 0


# --- operator 11 ----------------------------------------------------------------------


def spectrum(values, seed=1):
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return turn @ np.diag(values) @ turn.T


@pytest.mark.parametrize(
    "matrix",
    [
        spectrum([3.0]), spectrum([2.0, 1.0]), spectrum(np.linspace(9, 1, 70)), np.eye(10), np.diag([3.0, 3, 3, 2, 2, 1, 1, 0, 0]),
        spectrum([5.0] * 6 + [1.0] * 34), spectrum([5 + 1e-9 * i for i in range(6)] + [1.0] * 34), spectrum([1.0] + [0.0] * 20),
        np.zeros((5, 5)), np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    ],
)
def test_leading_components_of_hard_matrices(matrix):
    values, vectors = whitening.leading_components(matrix)
    scale = max(1e-300, np.abs(matrix).max())
    assert len(values) == min(8, len(matrix))
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][: len(values)], rtol=0, atol=1e-13 * max(scale, 1e6 * np.finfo(float).tiny) + 1e-300)
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-13 * scale + 1e-300
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13


def vector_rows(count=300, width=20, seed=2):
    rng = np.random.default_rng(seed)
    spread = rng.standard_normal((width, width)) * np.linspace(2, 0.1, width)
    return [[float(x) for x in row.astype(np.float32)] for row in rng.standard_normal((count, width)) @ spread]


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    matrix = centred.T @ centred / n
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    return ((n * x - sums) ** 2).sum(axis=1), centred @ axes / np.sqrt(values), values / np.trace(matrix)


def test_whitening_matches_plain_covariance(spark):
    good = vector_rows() + [[0.0] * 20]
    odd = [None, [], [1.0, None] + [0.0] * 18, [float("nan")] * 20, [float("inf")] + [0.0] * 19]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(900 + i, v, "x", 1) for i, v in enumerate(odd)]
    rows += [(7, good[7], "x", 1), (None, good[8], "x", 1)]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, width STRING, n INT").repartition(5)
    found = whitening.whitened(frame).collect()
    ids = [*range(301), 7, None]
    deviation, plain, share = plain_whitening(good + [good[7], good[8]])
    assert len(found) == 8 * 303 and {r.n for r in found} == {303}
    assert max(abs(r.identity_error) for r in found) < 1e-9
    for component in range(1, 9):
        part = [r for r in found if r.component == component]
        for sign in (1, -1):
            wanted = sorted((str(i), int(d), round(sign * float(p[component - 1]), 8) + 0.0) for i, d, p in zip(ids, deviation, plain))
            mine = sorted((str(r.vec_id), int(r.deviation), round(r.whitened, 8) + 0.0) for r in part)
            if np.allclose([m[2] for m in mine], [w[2] for w in wanted], atol=1e-7):
                break
        assert [m[:2] for m in mine] == [w[:2] for w in wanted]
        assert np.allclose([m[2] for m in mine], [w[2] for w in wanted], atol=1e-7)
        assert all(abs(r.explained - share[component - 1]) < 1e-12 for r in part)


def test_whitening_of_flat_mixed_huge_and_no_vectors(spark):
    schema = "vec_id LONG, embedding ARRAY<DOUBLE>"
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(90, [1.0]), (91, [1.0])], schema)
    found = whitening.whitened(flat).collect()
    first = [r for r in found if r.n == 9 and r.component == 1]
    assert len(found) == 9 * 3 + 2 and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in first)
    assert all(r.whitened is None for r in found if r.n == 2 or r.component > 1)
    assert all(r.explained is None and r.identity_error is None for r in found if r.n == 2)
    huge = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e300, 1.0])], schema)
    x = [[int(np.clip(1024 * c, -whitening.LARGEST, whitening.LARGEST)) + 100_000 for c in v] for v in ([1e12, 0.0], [-1e12, 1.0], [1e300, 1.0])]
    sums = [sum(c) for c in zip(*x)]
    wanted = [sum((3 * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    got = {r.vec_id: r.deviation for r in whitening.whitened(huge).where("component = 1").collect()}
    assert [got[i] for i in (1, 2, 3)] == [w if w < 10**38 else None for w in wanted]
    assert whitening.whitened(flat.limit(0)).count() == 0


# --- operator 13 ----------------------------------------------------------------------


def plain_nearest(rows, asks, k=10):
    out = []
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q, a in {(i, tuple(v)): (i, v) for i, v in sound if asks(i)}.values():
        near = [(float(np.sqrt(((v - a) ** 2).sum())), i) for i, v in sound if i != q and len(v) == len(a)]
        out += [(q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


ODD_VECTORS = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [1.0] * 5]


@pytest.mark.parametrize("shard, block", [(1 << 24, 1 << 22), (4_000, 200)])
def test_factor_one_is_exact(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vantage, "SHARD_BYTES", shard)
    monkeypatch.setattr(vantage, "QUERY_BYTES", block)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 6))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.2 * rng.standard_normal(6)]) for i in range(500)]
    # A third of all rows are one vector; some rows and ids repeat; a few have another dimension.
    rows += [(1_000 + i, rows[5][1]) for i in range(250)] + [rows[20], (40, rows[41][1]), (None, rows[1][1])]
    rows += [(2_000 + i, v) for i, v in enumerate(ODD_VECTORS)] + [(3_000 + i, [1.0, float(i)]) for i in range(4)]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").withColumn("cell", F.lit("x")).repartition(5)
    found = vantage.nearest(frame, F.col("vec_id") % 20 == 0, factor=1.0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found) == plain_nearest(rows, lambda i: i % 20 == 0)


def test_relaxed_search_keeps_most_neighbours_and_visits_less():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 24)) * 2
    data = centres[rng.integers(150, size=6_000)] + 0.5 * rng.standard_normal((6_000, 24))
    ids, asked = np.arange(6_000), np.arange(0, 6_000, 40)
    tree, cells = vantage.Tree.grow(ids, data), vantage.Cells.fit(data[:2_000])
    unlimited, found, visited = np.full(len(asked), np.inf), {}, {}
    for factor in (1.0, 2.0, 6.0):
        found[factor], scores = tree.search(data[asked], ids[asked], unlimited, 10, factor)
        visited[factor] = cells.within(data[asked], scores[:, -1], factor).mean()
    away = vantage.distances(data[asked], data)
    away[np.arange(len(asked)), asked] = np.inf
    wanted = np.argsort(away, axis=1, kind="stable")[:, :10]
    assert (found[1.0] == wanted).all()
    recall = {f: np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found[f], wanted)]) for f in found}
    assert recall[2.0] > 0.97 and visited[6.0] < visited[2.0] < visited[1.0] < 1


def test_nearest_in_small_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    found = vantage.nearest(frame, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [(0, 1, 3), (0, 2, 100), (100, 1, 3), (100, 2, 0)]
    assert vantage.nearest(frame.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert vantage.nearest(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_distances_of_extreme_vectors():
    for scale in (1e-200, 1.0, 1e200):
        away = vantage.distances(np.array([[0.0, 3.0 * scale]]), np.array([[4.0 * scale, 0.0], [0.0, 3.0 * scale]]))
        assert np.allclose(away / scale, [[5.0, 0.0]])
