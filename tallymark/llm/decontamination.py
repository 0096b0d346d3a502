"""Documents that hold benchmark items, up to a few edits (operator 8).

Both sides are normalised: lower case, and every run of characters that are neither
letters nor digits becomes one space. An item of m characters may differ by
k = m * ``ERRORS_PERCENT`` // 100 edits. Cut into k + 1 pieces, at least one piece must
occur unchanged wherever the item occurs within its budget. Documents are scanned for
pieces by a hash of each piece's first characters at every position; where a whole
piece stands, the item's distance to the best matching passage around it is computed
with Myers' bit-parallel recurrence, a column of the alignment at a time.

The benchmark is the query set. It is cut into blocks of at most ``BLOCK_CHARS``
characters, which bounds what goes to the workers; each block is one pass over the
documents, with no shuffle, so neither long documents nor frequent passages meet in one
task beyond their own row.

Null and empty texts match nothing. Items of every length are looked for, those without
an edit to spend by exact match; ``least_chars`` leaves shorter ones out, where a
benchmark has items too common to tell anything. Extra columns of either side are ignored
or kept as they are. An item found several
times in a document is one row, with its best passage. Repeated documents give repeated
rows; repeated items are found once each.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.bytehash import mix

ERRORS_PERCENT = 5
LEAST_CHARS = 1
BLOCK_CHARS = 4_000_000
#: Longest part of a piece that is hashed; shorter pieces make classes of their own.
ANCHOR = 16
#: Bits of the table that discards most positions before the exact look-up.
FILTER_BITS = 20

MATCH_SCHEMA = "doc_id BIGINT, item_id BIGINT, distance INT, item_chars INT, budget INT, start BIGINT, stop BIGINT"

_SPACES = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return _SPACES.sub(" ", text.lower()).strip()


def pieces(item: str) -> list[tuple[int, str]]:
    """Offsets and texts of the item's budget-plus-one pieces, of nearly equal length."""
    count = budget(item) + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def budget(item: str) -> int:
    return len(item) * ERRORS_PERCENT // 100


def best_passage(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to a substring of ``text``, and where that ends.

    Myers' recurrence: one big integer holds the increases and one the decreases down a
    column, so each character of the text costs a few word operations.
    """
    size = len(item)
    occurs: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        occurs[c] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size
    best = (distance, 0)
    for j, c in enumerate(text):
        equal = occurs.get(c, 0)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        rises, falls = down | (~(diagonal | up) & full), up & diagonal
        if rises & top:
            distance += 1
        elif falls & top:
            distance -= 1
        # The first row is free: an occurrence may begin anywhere.
        rises, falls = (rises << 1) & full, (falls << 1) & full
        up, down = falls | (~(vertical | rises) & full), rises & vertical
        if distance < best[0]:
            best = (distance, j + 1)
    return best if best[0] <= most else None


class Index:
    """Pieces of a block of items by the hash of their first characters, one table per length."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        by_size: dict[int, dict[int, list[tuple[int, int, str]]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, item) in enumerate(items):
            for offset, piece in pieces(item):
                size = min(ANCHOR, len(piece))
                code = np.frombuffer(piece[:size].encode("utf-32-le"), np.uint32)
                by_size[size][int(_windows(code, size)[0])].append((number, offset, piece))
        self.tables = []
        for size, table in sorted(by_size.items()):
            hashes = np.array(sorted(table), np.uint64)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((size, hashes, seen, dict(table)))


def _windows(code: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters from every position, by doubling the covered length."""
    value, covered = mix(code.astype(np.uint64) + np.uint64(1)), 1
    while covered < size:
        step = min(covered, size - covered)
        value = mix(value[: len(value) - step] * np.uint64(3) + value[step:])
        covered += step
    return value


def find_items(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """``(item number, distance, start, stop)`` of every item within its budget in ``text``."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    for size, hashes, seen, table in index.tables:
        if len(code) < size:
            continue
        value = _windows(code, size)
        maybe = np.flatnonzero(seen[value >> np.uint64(64 - FILTER_BITS)])
        own = value[maybe]
        place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        for at in maybe[hashes[place] == own]:
            at = int(at)
            for number, offset, piece in table[int(value[at])]:
                item = index.items[number][1]
                most = budget(item)
                # Starts that lie close together share one window.
                begin = at - offset
                cell = begin // (most + 1)
                if (number, cell) in tried or found.get(number, (1,))[0] == 0:
                    continue
                if not text.startswith(piece, at):
                    continue
                tried.add((number, cell))
                low = max(0, cell * (most + 1) - most)
                high = min(len(text), (cell + 1) * (most + 1) + len(item) + most)
                hit = best_passage(item, text[low:high], most)
                if hit and (number not in found or hit[0] < found[number][0]):
                    stop = low + hit[1]
                    found[number] = (hit[0], max(low, stop - len(item)), stop)
    return [(number, *match) for number, match in found.items()]


def _match_batches(shared):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text")):
                text = normalise(text.as_py() or "")
                for number, distance, start, stop in find_items(text, index):
                    item_id, item = index.items[number]
                    rows.append((doc_id, item_id, distance, len(item), budget(item), start, stop))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "item_id", "distance", "item_chars", "budget", "start", "stop"],
            )

    return run


def blocks(benchmark: DataFrame, least_chars: int = LEAST_CHARS):
    """Lists of ``(item_id, normalised text)`` of at most ``BLOCK_CHARS`` characters each."""
    block: list[tuple[int, str]] = []
    room = BLOCK_CHARS
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    for item_id, text in rows.distinct().toLocalIterator():
        item = normalise(text)
        if len(item) < max(1, least_chars):
            continue
        if block and len(item) > room:
            yield block
            block, room = [], BLOCK_CHARS
        block.append((item_id, item))
        room -= len(item)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per document and item found in it: distance, budget and the passage.

    ``start`` and ``stop`` are offsets in the normalised text; ``stop`` is where the best
    alignment ends and ``start`` its length before.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCH_SCHEMA)
    for block in blocks(benchmark, least_chars):
        out = out.union(texts.mapInArrow(_match_batches(spark.sparkContext.broadcast(block)), MATCH_SCHEMA))
    return out


def _clean_batches(shared):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            clean = [not find_items(normalise(text.as_py() or ""), index) for text in batch.column("text")]
            yield batch.select(["row"]).filter(pa.array(clean, pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` without the rows in which an item is found; all columns stay.

    Every row is judged by its own text, whatever its doc_id.
    """
    for block in blocks(benchmark, least_chars):
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = rows.mapInArrow(_clean_batches(shared), rows.select("row").schema).select("row.*")
    return docs
