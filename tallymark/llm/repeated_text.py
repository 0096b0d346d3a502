"""Removal of long repeated passages by suffix arrays (operator 1).

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else,
in the same document or another. Four steps, each a narrow scan or a shuffle of short
rows:

1. *Anchors.* In every window of ``WINDOW`` bytes the leftmost smallest hash of
   ``GRAM`` bytes is its anchor. Equal windows have equal anchors at equal offsets, so
   windows can only repeat within the group of one anchor hash. The windows of an anchor
   form a *piece*; about one piece starts every 170 bytes, and every window lies in one.
2. *Equal pieces.* Pieces are counted by anchor and content hash. Content seen twice is
   repeated as a whole; only one copy of it goes on, and only where the same anchor has
   other content too. Copies of documents, however many, end here.
3. *Suffix arrays.* What is left is dealt into shards of bounded size by anchor. Each
   shard sorts its suffixes by Larsson-Sadakane refinement (ranks of twice the length
   from ranks of the length so far, only within groups still tied) and takes Kasai's
   common prefixes of neighbours: a window that shares ``WINDOW`` bytes with a neighbour
   repeats.
4. *Across shards.* An anchor with more pieces than a shard may hold is dealt over
   several. Each of those also gives one digest per distinct window, as one sorted run
   per range of digests, and a merge of a range finds by binary search which digests
   other runs hold too. Other anchors never cross shards.

Texts are known by a 128-bit digest, so equal texts share their spans. Hashes of content
are 64 bits, compared within one anchor hash of 64 further bits. The text itself is
shuffled twice: to cut the pieces that need sorting, and to apply the spans.

Null texts are empty; texts shorter than a window keep everything. Repeated rows and ids
keep their rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.bytehash import CHUNK_BYTES, Powers, mix, prefix_sums, span_hashes, utf8
from tallymark.session import stage

WINDOW = 400
GRAM = 64
#: Bytes of pieces that one shard sorts.
SHARD_BYTES = 1 << 21
#: Pieces of one anchor beyond which it is dealt over several shards.
ANCHOR_PIECES = 2_000
#: No byte of UTF-8 text: ends every piece in a shard.
END = 0xFF

PIECE_SCHEMA = "text_id BINARY, anchor BIGINT, content BIGINT, low INT, high INT"
BODY_SCHEMA = "anchor BIGINT, content BIGINT, parts INT, body BINARY"
SHARD_SCHEMA = (
    "anchor BIGINT, content BIGINT, at INT, until INT, range INT, shard BIGINT, "
    "digests ARRAY<BIGINT>, anchors ARRAY<BIGINT>, contents ARRAY<BIGINT>, ats ARRAY<INT>"
)
#: Expected windows in one range of digests, the unit of a merge.
RANGE_WINDOWS = 500_000


# --- 1. anchors ---------------------------------------------------------------------


def sliding_minimum(value: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` consecutive values, by doubling the covered length."""
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        value = np.minimum(value[: len(value) - step], value[step:])
        covered += step
    return value


def text_pieces(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """``anchor, content, low, high`` of a text's pieces, each of the windows ``low..high``.

    A piece covers bytes ``low`` to ``high + WINDOW``. Texts longer than a chunk are
    scanned in chunks that overlap by a window; anchors depend on the window alone.
    """
    columns: list[tuple[np.ndarray, ...]] = []
    for origin in range(0, max(1, len(data) - WINDOW + 1), CHUNK_BYTES):
        part = data[origin : origin + CHUNK_BYTES + WINDOW - 1]
        if len(part) < WINDOW:
            continue
        sums = prefix_sums(part, powers)
        start = np.arange(len(part) - GRAM + 1)
        gram = span_hashes(sums, start, start + GRAM, powers)
        # The low bits hold the position: the smallest value is the leftmost of equal hashes.
        ranked = (gram & np.uint64(0xFFFFFFFFFFC00000)) | start.astype(np.uint64)
        place = (sliding_minimum(ranked, WINDOW - GRAM + 1) & np.uint64(0x3FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        at = place[first]
        content = span_hashes(sums, first, last + WINDOW, powers) ^ mix((at - first).astype(np.uint64))
        columns.append((gram[at], content, first + origin, last + origin))
    if not columns:
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    return tuple(np.concatenate(c) for c in zip(*columns))


def _piece_batches(batches):
    powers = Powers()
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        for i in range(batch.num_rows):
            anchor, content, low, high = text_pieces(data[bounds[i] : bounds[i + 1]], powers)
            if len(low):
                repeated = pa.DictionaryArray.from_arrays(
                    pa.array(np.zeros(len(low), np.int32)), batch.column("text_id").slice(i, 1)
                ).dictionary_decode()
                yield pa.RecordBatch.from_arrays(
                    [
                        repeated,
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        pa.array(low.astype(np.int32)),
                        pa.array(high.astype(np.int32)),
                    ],
                    ["text_id", "anchor", "content", "low", "high"],
                )


# --- 3. suffix arrays ---------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes; no byte of it is 0.

    Larsson-Sadakane: suffixes are first ranked by eight bytes; then each round sorts
    those still tied by the rank of the suffix as far ahead as they are known to agree.
    """
    size = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(size, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + size]
    order = np.argsort(key, kind="stable")
    rank, tied = np.empty(size + 1, np.int64), None
    rank[size] = -1
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    slot = np.arange(size)
    group = np.maximum.accumulate(np.where(head, slot, 0))
    rank[order] = group
    known = 8
    tied = _tied_slots(head)
    while len(tied):
        at = order[tied]
        ahead = rank[np.minimum(at + known, size)]
        own = rank[at]
        # One key for both ranks; a radix sort of it beats two passes over a pair.
        resort = np.argsort(own * (size + 2) + ahead + 1, kind="stable")
        at, own, ahead = at[resort], own[resort], ahead[resort]
        order[tied] = at
        head = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        rank[at] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[_tied_slots(head)]
        known *= 2
    return order


def _tied_slots(head: np.ndarray) -> np.ndarray:
    """Slots whose group, as marked by its head, has more than one member."""
    alone = head & np.concatenate([head[1:], [True]])
    return np.flatnonzero(~alone)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, up to ``depth``.

    Kasai's walk in text order: the next position shares at least one byte less than
    this one. Many stretches of the text are walked side by side, a position of each at
    a time, comparing eight bytes per step.
    """
    size = len(text)
    before = np.full(size, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    stretch = 64
    lanes = np.arange(0, size, stretch)
    shared = np.zeros(len(lanes), np.int64)
    lengths = np.zeros(size, np.int64)
    for step in range(stretch):
        lanes_now = lanes + step
        live = np.flatnonzero((lanes_now < size) & (before[np.minimum(lanes_now, size - 1)] >= 0))
        shared = np.maximum(shared - 1, 0)
        reset = np.ones(len(lanes), bool)
        reset[live] = False
        shared[reset] = 0
        grow = live
        while len(grow):
            here, there = lanes_now[grow], before[lanes_now[grow]]
            a = np.minimum(here + shared[grow], size)
            b = np.minimum(there + shared[grow], size)
            same = words[a] == words[b]
            run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            ended = np.minimum(run, size - np.maximum(a, b))
            shared[grow] += ended
            grow = grow[(ended == 8) & (shared[grow] < depth)]
        shared = np.minimum(shared, depth)
        lengths[lanes_now[live]] = shared[live]
    return lengths[order]


def repeated_windows(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """Windows that repeat among ``pieces``, and one place of each distinct window.

    Both as arrays of piece numbers and offsets; the last array is a hash per place.
    """
    sizes = np.array([len(p) + 1 for p in pieces])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(bytes([END]).join(pieces) + bytes([END]), np.uint8)
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    piece = np.searchsorted(begins, order, side="right") - 1
    offset = order - begins[piece]
    whole = offset + WINDOW < sizes[piece]
    # No window holds an end mark, so a neighbour that shares a window's bytes is one too.
    same = whole & (shared >= WINDOW)
    again = same | np.concatenate([same[1:], [False]])
    first = whole & ~same
    powers = Powers()
    digest = span_hashes(prefix_sums(text, powers), order[first], order[first] + WINDOW, powers)
    return piece[again], offset[again], piece[first], offset[first], digest


def _runs(piece: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive offsets of a piece as ``piece, first, last``."""
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(piece)]]) - 1 if len(first) else first
    return piece[first], offset[first], offset[last]


def _shard(ranges: int):
    """Repeated windows of one shard, and runs of digests for anchors that cross shards."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one = {ac: i for i, ac in enumerate(zip(table.column("anchor").to_pylist(), table.column("content").to_pylist()))}
        table = table.take(pa.array(sorted(one.values())))
        anchor, content = (np.asarray(table.column(n)) for n in ("anchor", "content"))
        crossing = np.asarray(table.column("parts")) > 1
        piece, offset, at_piece, at_offset, digest = repeated_windows(table.column("body").to_pylist())
        piece, first, last = _runs(piece, offset)
        out = crossing[at_piece]
        at_piece, at_offset, digest = at_piece[out], at_offset[out], digest[out].view(np.int64)
        order = np.lexsort((digest, digest % ranges))
        at_piece, at_offset, digest = at_piece[order], at_offset[order], digest[order]
        number = np.unique(digest % ranges)
        cuts = np.append(np.searchsorted(digest % ranges, number), len(digest)).astype(np.int32)
        local, runs = len(piece), len(number)

        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            # Rows of local windows have no lists; rows of runs have nothing else.
            full = pa.ListArray.from_arrays(pa.array(cuts), pa.array(values, kind))
            return pa.concat_arrays([pa.nulls(local, full.type), full])

        def single(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.concat_arrays([pa.array(values, kind), pa.nulls(runs, kind)])

        return pa.table(
            {
                "anchor": single(anchor[piece], pa.int64()),
                "content": single(content[piece], pa.int64()),
                "at": single(first, pa.int32()),
                "until": single(last, pa.int32()),
                "range": pa.concat_arrays([pa.nulls(local, pa.int32()), pa.array(number, pa.int32())]),
                "shard": pa.array(np.full(local + runs, key[0].as_py(), np.int64)),
                "digests": lists(digest, pa.int64()),
                "anchors": lists(anchor[at_piece], pa.int64()),
                "contents": lists(content[at_piece], pa.int64()),
                "ats": lists(at_offset, pa.int32()),
            }
        )

    return run


# --- 4. across shards ---------------------------------------------------------------


def merge_runs(shard: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which entries have their digest in the run of another shard as well.

    A run holds every digest once. Each run is searched for the digests of the runs
    before it, in sorted order, and both hits are marked.
    """
    found = np.zeros(len(digest), bool)
    order = np.lexsort((digest, shard))
    starts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(order) else []
    merged, where = np.empty(0, digest.dtype), np.empty(0, np.int64)
    for low, high in zip(starts, [*starts[1:], len(order)]):
        run = order[low:high]
        values = digest[run]
        place = np.searchsorted(merged, values)
        hit = np.zeros(len(run), bool)
        inside = place < len(merged)
        hit[inside] = merged[place[inside]] == values[inside]
        found[run[hit]] = True
        found[where[place[hit]]] = True
        merged = np.insert(merged, place[~hit], values[~hit])
        where = np.insert(where, place[~hit], run[~hit])
    return found


def _merge_table(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    sizes = np.asarray(table.column("digests").combine_chunks().value_lengths())
    flat = lambda name: np.asarray(table.column(name).combine_chunks().flatten())
    found = merge_runs(np.repeat(np.asarray(table.column("shard")), sizes), flat("digests"))
    at = flat("ats")[found]
    columns = {"anchor": flat("anchors")[found], "content": flat("contents")[found], "at": at, "until": at}
    return pa.table({n: pa.array(c) for n, c in columns.items()})


# --- the operator --------------------------------------------------------------------


def _body_batches(batches):
    for batch in batches:
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            data = text.as_py().encode()
            rows = wanted.as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["anchor"] for r in rows], pa.int64()),
                    pa.array([r["content"] for r in rows], pa.int64()),
                    pa.array([r["parts"] for r in rows], pa.int32()),
                    pa.array([data[r["low"] : r["high"] + WINDOW] for r in rows], pa.binary()),
                ],
                ["anchor", "content", "parts", "body"],
            )


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs of bytes."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _cut_batches(batches):
    """Remaining text and removed spans; a cut inside a character leaves its bytes apart."""
    for batch in batches:
        kept, spans = [], []
        for text, found in zip(batch.column("text"), batch.column("found")):
            data = text.as_py().encode()
            runs = merged_spans([(x["start"], x["stop"]) for x in found.as_py()])
            edges = [0, *(e for run in runs for e in run), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "stop": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t.as_py().encode()) for t in batch.column("text")], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def _text_id() -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("text_id")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``text_id, found``: byte spans covered by repeated windows, for texts that have any."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(), "text")
    pieces = stage(
        texts.where(F.octet_length("text") >= WINDOW).select("text_id", "text").mapInArrow(_piece_batches, PIECE_SCHEMA),
        "pieces",
    )
    # Written, so that the join below is of two plain shuffles and AQE can split an anchor
    # that very many pieces share.
    anchors = stage(
        pieces.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        .where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")),
        "anchors",
    )
    shared = stage(pieces.join(anchors, "anchor"), "shared_pieces")
    classes = shared.groupBy("anchor", "content", "mixed").agg(
        F.count("*").alias("n"), F.min(F.struct("text_id", "low", "high")).alias("one")
    )
    classes = stage(classes, "piece_classes")
    flagged = _sorted_windows(texts, classes.where("mixed"))
    whole = classes.where("n > 1").select("anchor", "content", F.lit(0).alias("at"), F.lit(None).cast("int").alias("until"))
    marks = flagged.union(whole)
    start = F.col("low") + F.col("at")
    stop = F.coalesce(F.col("low") + F.col("until"), F.col("high")) + WINDOW
    return (
        shared.select("text_id", "anchor", "content", "low", "high").join(marks, ["anchor", "content"])
        .select("text_id", start.cast("long").alias("start"), stop.cast("long").alias("stop"))
        .groupBy("text_id").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    )


def _sorted_windows(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``anchor, content, at, until``: runs of repeated windows, by suffix arrays in shards."""
    kinds = classes.groupBy("anchor").agg(F.count("*").alias("kinds"))
    parts = F.ceil(F.col("kinds") / ANCHOR_PIECES).cast("int")
    dealt = stage(classes.join(kinds.select("anchor", parts.alias("parts")), "anchor"), "sorted_pieces")
    windows = F.col("one.high") - F.col("one.low") + 1
    sums = dealt.agg(
        F.sum(windows + WINDOW - 1).alias("volume"), F.sum(F.when(F.col("parts") > 1, windows)).alias("crossing")
    ).first()
    shards = max(1, -(-(sums["volume"] or 0) // SHARD_BYTES))
    ranges = 1 + (sums["crossing"] or 0) // RANGE_WINDOWS
    wanted = (
        dealt.groupBy("one.text_id")
        .agg(F.collect_list(F.struct("anchor", "content", "parts", "one.low", "one.high")).alias("wanted"))
    )
    # Of equal texts one is cut, whatever ids their rows have.
    one = texts.groupBy("text_id").agg(F.first("text").alias("text"))
    cut = one.join(wanted, "text_id").select("text", "wanted")
    bodies = cut.mapInArrow(_body_batches, BODY_SCHEMA)
    slot = F.xxhash64("anchor", F.pmod("content", F.col("parts").cast("long")))
    found = stage(
        bodies.withColumn("shard", F.pmod(slot, F.lit(shards))).groupBy("shard").applyInArrow(_shard(ranges), SHARD_SCHEMA),
        "repeated_windows",
    )
    crossed = found.where("range IS NOT NULL").groupBy("range").applyInArrow(
        _merge_table, "anchor BIGINT, content BIGINT, at INT, until INT"
    )
    return found.where("range IS NULL").select("anchor", "content", "at", "until").union(crossed)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row; ``kept`` are the remaining bytes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(repeated_spans(docs), "text_id", "left").select("doc_id", "text", "found")
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>)")
    return joined.select("doc_id", "text", F.coalesce("found", empty).alias("found")).mapInArrow(
        _cut_batches, "doc_id BIGINT, n_bytes BIGINT, spans ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>, kept BINARY"
    )
