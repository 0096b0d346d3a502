"""Toxic passages and a toxicity score for every document (operator 9).

Token log-odds: among labelled documents, the share of a token's documents that are
toxic, smoothed by a Dirichlet prior whose mean is the share of the token's stem, and
the stem's by that of a shorter stem, up to the share over all documents. So a word
that no label has seen is judged by how it begins.

Passages: log-odds minus a drift give every token a score that is negative on average.
One linear scan finds all maximal scoring segments of a document. Under the background
the best score of n tokens follows an extreme-value law, P(S < x) = exp(-K n e^(-lambda x));
lambda comes from the token scores of clean documents, K from their best segments. The
law takes tokens as independent, but a word that stands once soon stands again. So the
k-th occurrence of a word inside one stretch adds a k-th of its score; what stands outside
the stretch does not matter. A segment has the score of its best stretch, and is
significant by that law; the document's evidence is the sum of its significant segments'
log p-values, mapped to 0..1 by a logistic curve.

The classifier is fitted on a bounded sample: about ``TRAIN_ROWS`` labelled documents
chosen by hash, a fifth of them for calibration, and about ``MAX_FEATURES`` tokens and
stems with most evidence among them, found by a histogram of the evidence. Only these
reach the driver. Scoring covers every whole text.

Null and empty texts have no tokens and get the score of no evidence. Without labels of
both kinds, every score is 0. Rows repeat as they come; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.bytehash import Powers, letter_spans, lower_latin, prefix_sums, row_chunks, span_hashes, utf8
from tallymark.session import stage

TRAIN_ROWS = 40_000
MAX_FEATURES = 200_000
#: Steps of evidence in its histogram, per standard deviation.
STEPS = 64
#: Bytes of the stems behind a word, longest first; a word is level 0.
STEMS = (8, 6, 4)
#: Documents that a prior is worth.
PRIOR = 2.0
#: Taken from every token's log-odds.
DRIFT = 1.0
SIGNIFICANT = 0.01

COUNTS_SCHEMA = "level INT, token BIGINT, parent BIGINT, toxic BIGINT, clean BIGINT"
CALIBRATION_SCHEMA = "toxic INT, tokens BIGINT, best DOUBLE, tally BIGINT"
SCORE_SCHEMA = (
    "score DOUBLE, evidence DOUBLE, "
    "passages ARRAY<STRUCT<start: BIGINT, stop: BIGINT, score: DOUBLE, p_value: DOUBLE>>"
)


@dataclass
class Model:
    """Token scores by level, and the constants of the extreme-value law and the curve."""

    tokens: list[np.ndarray]
    weights: list[np.ndarray]
    rest: float
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    intercept: float = -40.0


# --- tokens -------------------------------------------------------------------------


def _levels(sums, start, end, powers) -> list[np.ndarray]:
    """Hashes of words, then of their stems; a stem is told apart from a word by its level."""
    return [span_hashes(sums, start, end, powers)] + [
        span_hashes(sums, start, np.minimum(end, start + size), powers) for size in STEMS
    ]


def _tokens(data: np.ndarray, bounds: np.ndarray, powers: Powers):
    lowered = lower_latin(data)
    start, end = letter_spans(lowered, bounds)
    return start, end, prefix_sums(lowered, powers)


def _blocks(batch: pa.RecordBatch):
    data, bounds = utf8(batch.column("text"))
    for low, high in row_chunks(bounds):
        yield low, high, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]


def _count_batches(batches):
    powers = Powers()
    for batch in batches:
        label = np.asarray(batch.column("toxic"))
        for low, high, data, bounds in _blocks(batch):
            start, end, sums = _tokens(data, bounds, powers)
            row = np.searchsorted(bounds, start, side="right") - 1
            hashes = _levels(sums, start, end, powers)
            for level, own in enumerate(hashes):
                parent = hashes[level + 1] if level + 1 < len(hashes) else np.zeros_like(own)
                order = np.lexsort((row, own))
                sorted_own, sorted_row = own[order], row[order]
                keep = np.ones(len(order), bool)
                keep[1:] = (sorted_own[1:] != sorted_own[:-1]) | (sorted_row[1:] != sorted_row[:-1])
                order = order[keep]
                token, at = np.unique(own[order], return_index=True)
                toxic = label[low:high][row[order]] == 1
                counts = np.add.reduceat(np.stack([toxic, ~toxic]).astype(np.int64), at, axis=1) if len(at) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(token), level, np.int32)),
                        pa.array(token.view(np.int64)),
                        pa.array(parent[order][at].view(np.int64)),
                        pa.array(counts[0]),
                        pa.array(counts[1]),
                    ],
                    ["level", "token", "parent", "toxic", "clean"],
                )


def _weigh(model: Model, sums, start, end, powers) -> tuple[np.ndarray, np.ndarray]:
    """Score of every token: its own if known, else that of its longest known stem; and a number for each word."""
    words = span_hashes(sums, start, end, powers)
    unique, at, inverse = np.unique(words, return_index=True, return_inverse=True)
    out = np.full(len(unique), model.rest)
    open_ = np.arange(len(unique))
    for level in range(len(STEMS) + 1):
        known = model.tokens[level]
        if not len(open_) or not len(known):
            continue
        first, last = start[at[open_]], end[at[open_]]
        own = unique[open_] if level == 0 else span_hashes(
            sums, first, np.minimum(last, first + STEMS[level - 1]), powers
        )
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[place] == own
        out[open_[hit]] = model.weights[level][place[hit]]
        open_ = open_[~hit]
    return out[inverse], inverse


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last + 1, score)`` in one pass.

    Only tokens with positive scores can begin or end one, so the scan steps from one
    positive token to the next and takes what lies between from running sums.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # Each entry ends with the index of the nearest earlier one that begins lower, so
    # that no stretch is searched twice.
    found: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0):
        first, left, right = int(i), float(sums[i]), float(sums[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            first, left, lower = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = lower
        found.append((first, int(i) + 1, left, right, j))
    return [(first, stop, right - left) for first, stop, left, right, _ in found]


def _damped(scores: np.ndarray, words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Positive scores divided by the number of the word's occurrence in its part."""
    out, raised = scores.copy(), np.flatnonzero(scores > 0)
    order = raised[np.lexsort((raised, words[raised], part[raised]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (part[order][1:] != part[order][:-1]) | (words[order][1:] != words[order][:-1])
    at = np.arange(len(order))
    out[order] /= 1 + at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def stretch_score(scores: np.ndarray, words: np.ndarray) -> float:
    """The best score of a stretch of a segment, repeats inside the stretch damped.

    Repeats are counted afresh in windows of every power of two that overlap by half: every
    stretch lies in a window less than four times as long.
    """
    raised = words[scores > 0]
    if len(np.unique(raised)) == len(raised):
        return float(scores.sum())
    best, size = float(scores.max()), 2
    while True:
        step = size // 2
        count = max(1, -(-len(scores) // step) - 1)
        at = np.arange(count)[:, None] * step + np.arange(size)
        inside = at < len(scores)
        place = np.where(inside, at, 0)
        own = np.where(inside, scores[place], 0.0).ravel()
        own = _damped(own, words[place].ravel(), np.repeat(np.arange(count), size)).reshape(count, size)
        sums = np.concatenate([np.zeros((count, 1)), np.cumsum(own, axis=1)], axis=1)
        best = max(best, float((sums - np.minimum.accumulate(sums, axis=1)).max()))
        if size >= len(scores):
            return best
        size *= 2


# --- fitting ------------------------------------------------------------------------


def _sample(labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """About ``rows`` labelled documents, those with the least hashes; ``fit`` marks four fifths.

    The bound on the hash follows from the number of labels, so nothing is sorted or sent
    to the driver; twice ``rows`` are never exceeded.
    """
    one = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    count = one.count()
    if count > rows:
        bound = int(rows / count * (1 << 32))
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < bound).limit(2 * rows)
    return one.withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) != 0)


def _strongest(counts: DataFrame) -> Column:
    """Which of the ``counts`` have the most evidence, about ``MAX_FEATURES``; the last step in part, by hash."""
    left, least, part = MAX_FEATURES, None, 0.0
    for step, size in sorted(counts.groupBy("step").agg(F.count("*")).collect(), reverse=True):
        if size > left:
            part = left / size
            break
        left, least = left - size, step
    drawn = F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < int(part * (1 << 30))
    above = F.lit(False) if least is None else F.col("step") >= least
    return above | ((F.col("step") == step) & drawn) if part else above


def _log_odds(share: np.ndarray) -> np.ndarray:
    return np.log(share) - np.log1p(-share)


def _fit_weights(counts, share: float) -> Model:
    """Smooth every level by the one above it; ``counts`` is the bounded feature table."""
    shares: dict[int, float] = {}
    tokens, weights = [np.empty(0, np.uint64)] * (len(STEMS) + 1), [np.empty(0)] * (len(STEMS) + 1)
    for level in range(len(STEMS), -1, -1):
        rows = counts[counts.level == level].sort_values("token", key=lambda c: c.astype("uint64"))
        prior = np.array([shares.get(p, share) for p in rows.parent.to_numpy()], float)
        own = (rows.toxic.to_numpy() + PRIOR * prior) / (rows.toxic.to_numpy() + rows.clean.to_numpy() + PRIOR)
        own = np.clip(own, 1e-4, 1 - 1e-4)
        shares = dict(zip(rows.token.to_numpy(), own))
        tokens[level] = rows.token.to_numpy().astype(np.int64).view(np.uint64)
        weights[level] = _log_odds(own) - _log_odds(np.array(share)) - DRIFT
    return Model(tokens, weights, -DRIFT)


def _calibration_batches(model):
    def run(batches):
        powers, fitted = Powers(), Model(**model.value)
        for batch in batches:
            label = np.asarray(batch.column("toxic"))
            rows: list[tuple[int, int, float, int]] = []
            for low, high, data, bounds in _blocks(batch):
                start, end, sums = _tokens(data, bounds, powers)
                weight, word = _weigh(fitted, sums, start, end, powers)
                first, part = np.searchsorted(start, bounds), np.full(len(start), -1)
                for i in range(high - low):
                    own, named = weight[first[i] : first[i + 1]], word[first[i] : first[i + 1]]
                    segments, best = maximal_segments(own), 0.0
                    for a, b, score in segments:
                        if score > best:
                            best = max(best, stretch_score(own[a:b], named[a:b]))
                        part[first[i] + a : first[i] + b] = first[i] + a
                    rows.append((int(label[low + i]), len(own), best, 0))
                clean = np.repeat(label[low:high] == 0, np.diff(first))
                value, number = np.unique(np.round(_damped(weight, word, part)[clean], 1), return_counts=True)
                rows += [(-1, 0, float(v), int(n)) for v, n in zip(value, number)]
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.int64()))],
                ["toxic", "tokens", "best", "tally"],
            )

    return run


def _rate(value: np.ndarray, tally: np.ndarray) -> float:
    """The lambda at which the mean of e^(lambda * score) is 1."""
    if not len(value) or value.max() <= 0:
        return 1.0
    share, low, high = tally / tally.sum(), 1e-3, 50.0
    excess = lambda x: float(np.log(np.sum(share * np.exp(np.minimum(x * value, 700)))))
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton steps with a small ridge."""
    beta, x = np.zeros(2), np.stack([evidence, np.ones_like(evidence)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (toxic - p) - 1e-3 * beta
        )
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return float(beta[0]), float(beta[1])


def _evidence(model: Model, tokens, best) -> np.ndarray:
    """Minus log10 p-value of a best score among ``tokens``; 0 where there is no passage."""
    expected = model.scale * np.maximum(tokens, 1) * np.exp(-model.rate * np.minimum(best, 300.0))
    p = -np.expm1(-expected)
    return np.where(np.asarray(best) > 0, np.minimum(-np.log10(np.maximum(p, 1e-30)), 30.0), 0.0)


def fit(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents; ``usable`` is a condition on ``doc_id``."""
    usable = F.lit(True) if usable is None else usable
    # At most twice ``rows`` rows of three short columns: a bounded broadcast.
    sample = F.broadcast(_sample(labels, usable, rows))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    training = known.where("fit").select("text", "toxic")
    sizes = {r.toxic: r["count"] for r in known.where("fit").groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model([np.empty(0, np.uint64)] * (len(STEMS) + 1), [np.empty(0)] * (len(STEMS) + 1), -DRIFT)
    share = sizes[1] / (sizes[0] + sizes[1])
    seen = F.col("toxic") + F.col("clean")
    evidence = F.abs(F.col("toxic") - seen * share) / F.sqrt(seen)
    counts = stage(
        training.mapInArrow(_count_batches, COUNTS_SCHEMA)
        .groupBy("level", "token", "parent").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(seen > 1).withColumn("step", F.floor(evidence * STEPS)),
        "token_counts",
    )
    counts = counts.where(_strongest(counts)).drop("step").toPandas()
    model = _fit_weights(counts, share)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model).copy())
    found = known.where("NOT fit").select("text", "toxic").mapInArrow(
        _calibration_batches(shared), CALIBRATION_SCHEMA
    ).groupBy("toxic", "tokens", "best").agg(F.sum("tally").alias("tally"), F.count("*").alias("n")).toPandas()
    scores, texts = found[found.toxic == -1], found[found.toxic >= 0]
    model.rate = _rate(scores.best.to_numpy(), scores.tally.to_numpy())
    clean = texts[texts.toxic == 0]
    weight = clean.n.to_numpy()
    pressure = float(np.sum(weight * clean.tokens.to_numpy() * np.exp(-model.rate * clean.best.to_numpy())))
    model.scale = min(1.0, max(weight.sum(), 1) / max(pressure, 1.0))
    evidence = np.repeat(_evidence(model, texts.tokens.to_numpy(), texts.best.to_numpy()), texts.n.to_numpy())
    model.slope, model.intercept = _curve(evidence, np.repeat(texts.toxic.to_numpy(), texts.n.to_numpy()))
    return model


# --- scoring ------------------------------------------------------------------------


def _score_batches(model, names):
    def run(batches):
        powers, fitted = Powers(), Model(**model.value)
        for batch in batches:
            for low, high, data, bounds in _blocks(batch):
                start, end, sums = _tokens(data, bounds, powers)
                weight, word = _weigh(fitted, sums, start, end, powers)
                first = np.searchsorted(start, bounds)
                evidence, passages = np.zeros(high - low), []
                for i in range(high - low):
                    own, named = weight[first[i] : first[i + 1]], word[first[i] : first[i + 1]]
                    found = []
                    for a, b, score in maximal_segments(own):
                        strength = float(_evidence(fitted, len(own), score))
                        if strength >= -np.log10(SIGNIFICANT) or strength > evidence[i]:
                            score = stretch_score(own[a:b], named[a:b])
                            strength = float(_evidence(fitted, len(own), score))
                        if strength >= -np.log10(SIGNIFICANT):
                            begin, stop = start[first[i] + a] - bounds[i], end[first[i] + b - 1] - bounds[i]
                            found.append({"start": int(begin), "stop": int(stop), "score": score, "p_value": 10.0**-strength})
                        evidence[i] = max(evidence[i], strength)
                    if len(found) > 1:
                        evidence[i] = min(30.0, sum(-np.log10(x["p_value"]) for x in found))
                    passages.append(found)
                score = 1 / (1 + np.exp(-np.clip(fitted.slope * evidence + fitted.intercept, -40, 40)))
                kept = [batch.column(n).slice(low, high - low) for n in names]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(score), pa.array(evidence), pa.array(passages, kind)],
                    [*names, "score", "evidence", "passages"],
                )

    return run


def score(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score``, ``evidence`` and significant ``passages`` (byte offsets)."""
    frame = docs.select(*dict.fromkeys([*keep, "text"]))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model).copy())
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keep)
    return frame.mapInArrow(_score_batches(shared, list(keep)), f"{kept}, {SCORE_SCHEMA}")
