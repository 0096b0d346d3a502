"""Periodic runs of words, and texts without the repetitions in them (operator 12).

A run is a maximal stretch of words with smallest period q (words q apart are equal) and
at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods. Every run holds a Lyndon
root, that is the longest Lyndon word at its place under the order of words or under the
opposite one. So there are two candidates per word, and two longest-common-extension
queries tell how far the period of each reaches:

1. *Ukkonen trees* of the words and of the reversed words, built online with suffix
   links. Preorder ranks of leaves are the order of suffixes.
2. *Lyndon roots.* The longest Lyndon word at a place ends before the next smaller
   suffix; under the opposite order, before the next greater one.
3. *Extensions.* The common extension of two places is the depth of the lowest common
   ancestor of their leaves: a minimum over the Euler tour, in constant time from a
   table of linear size. The tree of the words gives extensions to the right, that of
   the reversal those to the left.

A run of length L and period q repeats its first L - q words q places further on, and
L - q is at least ``2/3 * LEAST_WORDS``. Hence each of its words lies in a stretch of
that many words that stands twice in its text, and trees are built only of the parts
made of such stretches. They are found by hashes of fixed length, vectorised over blocks
of texts; a run never crosses the border of a part, so this drops none, and words of a
part are compared as bytes.

A null text has no words. Texts are handled whole by the task that reads them, without a
shuffle; memory grows with the longest repetitive part of one text. Repeated rows, null
or repeated ids and further columns do not matter; ``doc_id`` passes through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.bytehash import Powers, mix, row_chunks, utf8, word_hashes

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of a stretch that a run repeats for certain; a power of two for doubling.
STRETCH = LEAST_WORDS * (LEAST_PERIODS - 1) // LEAST_PERIODS
BLOCK = 32

RUN_SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>, collapsed STRING"
)


# --- suffix trees ---------------------------------------------------------------------


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (integers from 1) closed by a 0, with common extensions."""

    def __init__(self, symbols: list[int]) -> None:
        self.size = len(symbols)
        text = [*symbols, 0]
        self._width = max(text) + 1
        self._grow(text)
        self._tour()

    def _grow(self, text: list[int]) -> None:
        """Add one symbol at a time; nodes are numbers, 0 the root, in parallel lists."""
        width, size = self._width, len(text)
        child: dict[int, int] = {}
        first, stop, link, leaves = [0], [0], [0], []
        node = edge = along = pending = 0
        for i, symbol in enumerate(text):
            pending += 1
            unlinked = 0
            while pending:
                if not along:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    leaves.append(len(first))
                    first.append(i), stop.append(size), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    begin = first[below]
                    span = min(stop[below], i + 1) - begin
                    if along >= span:
                        edge += span
                        along -= span
                        node = below
                        continue
                    if text[begin + along] == symbol:
                        along += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    # The edge parts here: a new inner node with the old end and a new leaf.
                    inner = len(first)
                    first.append(begin), stop.append(begin + along), link.append(0)
                    leaves.append(inner + 1)
                    first.append(i), stop.append(size), link.append(0)
                    first[below] = begin + along
                    child[key] = inner
                    child[inner * width + symbol] = inner + 1
                    child[inner * width + text[begin + along]] = below
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                pending -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = i - pending + 1
        self._child, self._leaves = child, np.array(leaves)
        self._length = np.array(stop) - np.array(first)

    def _tour(self) -> None:
        """Preorder ranks of leaves, and the depth at which each node of the tour hangs."""
        keys = np.fromiter(self._child.keys(), np.int64, len(self._child))
        below = np.fromiter(self._child.values(), np.int64, len(self._child))
        order = np.argsort(keys)
        parent, below = keys[order] // self._width, below[order]
        nodes = len(self._length)
        begin = np.searchsorted(parent, np.arange(nodes + 1)).tolist()
        # Children are pushed from last to first, so that the first is visited first.
        kids, length = below.tolist(), self._length.tolist()
        depth, place, hangs = [0] * nodes, [0] * nodes, []
        stack, above = [0], [0] * nodes
        while stack:
            node = stack.pop()
            place[node] = len(hangs)
            hangs.append(above[node])
            low, high = begin[node], begin[node + 1]
            if low < high:
                depth[node] = here = above[node] + length[node]
                for k in range(high - 1, low - 1, -1):
                    above[kids[k]] = here
                    stack.append(kids[k])
        del self._child
        self.rank = np.array(place)[self._leaves]
        self._lowest = RangeMinimum(np.array(hangs, np.int32))

    def common_extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols shared by the suffixes at ``a`` and ``b``, which differ pairwise."""
        x, y = self.rank[a], self.rank[b]
        return self._lowest(np.minimum(x, y) + 1, np.maximum(x, y))


class RangeMinimum:
    """Minima of ranges in constant time: short spans directly, long ones over blocks."""

    def __init__(self, values: np.ndarray) -> None:
        self._short = self._doubled(values, BLOCK)
        self._blocks = self._doubled(self._short[-1][::BLOCK], None)

    @staticmethod
    def _doubled(values: np.ndarray, most: int | None) -> list[np.ndarray]:
        """Minima of 1, 2, 4, ... values from each place on, cut at the end."""
        levels, span = [values], 1
        while span < (most or len(values)):
            last = levels[-1]
            longer = last.copy()
            if span < len(last):
                longer[:-span] = np.minimum(last[:-span], last[span:])
            levels.append(longer)
            span *= 2
        return levels

    def _between(self, levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(levels[k][low[at]], levels[k][high[at] - (1 << int(k)) + 1])
        return out

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of each ``low..high``, ends included."""
        out = np.empty(len(low), np.int64)
        near = high - low < BLOCK
        out[near] = self._between(self._short, low[near], high[near])
        low, high = low[~near], high[~near]
        longest = self._short[-1]
        ends = np.minimum(longest[low], longest[high - BLOCK + 1]).astype(np.int64)
        begin, stop = -(-low // BLOCK), (high + 1) // BLOCK - 1
        inside = begin <= stop
        ends[inside] = np.minimum(ends[inside], self._between(self._blocks, begin[inside], stop[inside]))
        out[~near] = ends
        return out


# --- runs -----------------------------------------------------------------------------


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length."""
    out, waiting = [len(values)] * len(values), []
    for i, value in enumerate(values):
        while waiting and values[waiting[-1]] > value:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def runs_of(symbols: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows ``start, length, period`` of all runs in ``symbols``, by start and period."""
    size = len(symbols)
    ahead, behind = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = ahead.rank[:size]
    ends = np.concatenate([next_smaller(rank.tolist()), next_smaller((-rank).tolist())]).astype(np.int64)
    begins = np.tile(np.arange(size), 2)
    inner = ends < size
    begins, ends = begins[inner], ends[inner]
    right = ahead.common_extension(begins, ends)
    left = behind.common_extension(size - begins, size - ends)
    period = ends - begins
    length = period + left + right
    found = length >= np.maximum(least, periods * period)
    table = np.stack([begins - left, length, period], axis=1)[found]
    table = np.unique(table, axis=0)
    return table[np.lexsort((table[:, 2], table[:, 0]))]


def repetitive_parts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows ``row, low, high``: words of a text covered by stretches that it has twice.

    ``first`` holds the index of each row's first word and the end of the last row.
    """
    count = len(hashes)
    if count < STRETCH:
        return np.empty((0, 3), np.int64)
    gram, span = mix(hashes), 1
    while span < STRETCH:
        gram = mix(gram[: len(gram) - span] * np.uint64(0x9E3779B97F4A7C15) + gram[span:])
        span *= 2
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(np.arange(len(gram)) + STRETCH <= first[row[: len(gram)] + 1])
    key = gram[at] + mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(count + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + STRETCH, -1)
    covered = np.cumsum(edge[:-1]) > 0
    border = np.zeros(count + 1, bool)
    border[first] = True
    low = np.flatnonzero(covered & (np.concatenate([[True], ~covered[:-1]]) | border[:-1]))
    high = np.flatnonzero(covered & (np.concatenate([~covered[1:], [True]]) | border[1:])) + 1
    parts = np.stack([row[low], low - first[row[low]], high - first[row[low]]], axis=1)
    return parts[high - low >= LEAST_WORDS]


def runs_of_words(words: list[bytes], parts: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of one text, whose repetitive parts are ``low, high``."""
    out = []
    for low, high in parts.tolist():
        number: dict[bytes, int] = {}
        symbols = [number.setdefault(w, len(number) + 1) for w in words[low:high]]
        out += [(low + s, n, p) for s, n, p in runs_of(symbols).tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repetitions(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    edge = [0] * (len(words) + 1)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept, inside = [], 0
    for word, step in zip(words, edge):
        inside += step
        if not inside:
            kept.append(word)
    return kept


def _run_batches(batches):
    powers = Powers()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for low, high in row_chunks(bounds):
            own = bounds[low : high + 1] - bounds[low]
            block = data[bounds[low] : bounds[high]]
            hashes, first = word_hashes(block, own, powers)
            parts = repetitive_parts(hashes, first)
            cuts = np.searchsorted(parts[:, 0], np.arange(high - low + 1))
            content = block.tobytes()
            counts, runs, kept = [], [], []
            for i in range(high - low):
                words = content[own[i] : own[i + 1]].split()
                found = runs_of_words(words, parts[cuts[i] : cuts[i + 1], 1:])
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(b" ".join(without_repetitions(words, found)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array(counts, pa.int64()),
                    pa.array(runs, run_type),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row; ``collapsed`` is the text without repetitions.

    ``runs`` are ordered by start and period, and count words from 0. ``collapsed`` has
    one space between words.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run_batches, RUN_SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the most periods, compared exactly; the earliest, then shortest period, of equal ones."""

    def rank(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(more > less, -1).when(more < less, 1)
            .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    return F.get(F.array_sort(runs, rank), F.lit(0))
