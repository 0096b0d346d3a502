"""Language of every text, words first (operator 7).

A known word adds its smoothed log frequency in each language. An unseen word is scored
by the longest character n-grams of it that are known, from four characters down to
one, averaged so that it weighs as much as a word. The sums are divided by the square
root of the number of words, as neighbouring words are not independent, and a softmax
gives the share of the best language.

Counts cover all usable texts, whole, and all languages. The vocabulary holds about the
``WORDS`` most frequent words and ``GRAMS`` most frequent n-grams of each length of every
language; a term in it has its full count in each language that uses it, and frequencies
divide by a language's full total. The model is sparse, so it grows with these counts
and not with terms times languages; should it exceed ``ENTRIES`` counts, the vocabulary
of every language is halved until it does not. No language is left out.

The most frequent terms of a language are found by a histogram of its counts: the count
down to which terms fit the vocabulary, and, of the terms with just the next lower count,
a share chosen by hash.

Words are runs of letters and marks, lower-cased, in any script. Null texts and texts
without a letter are ``und`` with score 0, as is every text when there is nothing to learn
from. Long texts are handled whole, alone in a block. Repeated rows count each time; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.bytehash import Powers, hash_terms, prefix_sums, row_chunks, span_hashes, utf8, word_spans
from tallymark.session import stage

WORDS = 20_000
GRAMS = 10_000
#: Counts of terms in languages that a model holds at most, about 16 bytes each.
ENTRIES = 8_000_000
LONGEST = 4
#: Count that every word and n-gram has beforehand in every language.
SMOOTHING = 0.1
UNKNOWN = "und"
#: Numbers that a task remembers for unseen words.
REMEMBERED = 2_000_000


def plain_words(text: Column) -> Column:
    """Lower-cased words with one space between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]++", " ")


def _words(data: np.ndarray, bounds: np.ndarray, powers: Powers):
    """Spans and hashes of all words, and the first word of each row."""
    start, end = word_spans(data, bounds)
    return start, end, span_hashes(prefix_sums(data, powers), start, end, powers), np.searchsorted(start, bounds)


def _count_batches(batches):
    powers = Powers()
    for batch in batches:
        data, bounds = utf8(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        codes, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
        for low, high in row_chunks(bounds):
            block = data[bounds[low] : bounds[high]]
            start, end, hashes, first = _words(block, bounds[low : high + 1] - bounds[low], powers)
            lang = np.repeat(codes[low:high], np.diff(first))
            raw = block.tobytes()
            for code in np.unique(lang):
                own = np.flatnonzero(lang == code)
                _, at, number = np.unique(hashes[own], return_index=True, return_counts=True)
                texts = [raw[start[i] : end[i]].decode("utf-8", "replace") for i in own[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[code]] * len(at), pa.string()), pa.array(texts, pa.string()), pa.array(number.astype(np.int64))],
                    ["lang", "word", "n"],
                )


@dataclass
class Terms:
    """Terms by sorted hash, each with its languages and what it adds to their scores there.

    ``base`` is the log frequency of a term that a language never uses; ``gain`` is what
    the counts of term i, at ``begin[i]`` to ``begin[i + 1]``, add to it.
    """

    hashes: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of terms, -1 where unknown."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place, -1)

    def add(self, total: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
        """Add the scores of terms at ``place`` to the rows ``row`` of ``total``."""
        size = self.begin[place + 1] - self.begin[place]
        entry = np.repeat(self.begin[place] - np.cumsum(size) + size, size) + np.arange(size.sum())
        width = total.shape[1]
        flat = np.bincount(np.repeat(row, size) * width + self.lang[entry], self.gain[entry], minlength=total.size)
        total += flat.reshape(total.shape)
        total += np.bincount(row, minlength=len(total))[:, None] * self.base


def _terms(found, totals: np.ndarray, place: dict[str, int]) -> Terms:
    """The table of ``term, lang, n`` rows, given each language's full total."""
    names = sorted(set(found.term))
    hashes = hash_terms(names) if names else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    number = {names[i]: k for k, i in enumerate(order)}
    row = np.array([number[t] for t in found.term], np.int64)
    lang = np.array([place[x] for x in found.lang], np.int32)
    by_row = np.lexsort((lang, row))
    begin = np.searchsorted(row[by_row], np.arange(len(names) + 1))
    gain = np.log1p(found.n.to_numpy(float) / SMOOTHING)
    base = np.log(SMOOTHING) - np.log(totals + SMOOTHING * max(1, len(names)))
    return Terms(hashes[order], begin, lang[by_row], gain[by_row], base)


def _vocabulary(counts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``keys, term`` of about the ``limit`` most frequent terms of each key."""
    sizes = counts.groupBy(*keys, "n").agg(F.count("*").alias("terms"))
    # One row per key and count that occurs: few, as most counts are small.
    falling = Window.partitionBy(*keys).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sizes.withColumn("upto", F.sum("terms").over(falling))
    fitting = F.when(F.col("upto") <= limit, F.col("n"))
    edge = reached.groupBy(*keys).agg(
        F.min(fitting).alias("least"), F.coalesce(F.max(F.when(F.col("upto") <= limit, F.col("upto"))), F.lit(0)).alias("taken"),
        F.max(F.when(F.col("upto") > limit, F.col("n"))).alias("next"),
        F.max(F.when(F.col("upto") > limit, F.struct("n", "terms"))).alias("after"),
    )
    share = (F.lit(limit) - F.col("taken")) / F.col("after.terms")
    drawn = F.pmod(F.xxhash64("term"), F.lit(1 << 30)) < share * (1 << 30)
    # One row per key.
    return counts.join(F.broadcast(edge), keys).where(
        (F.col("n") >= F.col("least")) | ((F.col("n") == F.col("next")) & drawn)
    ).select(*keys, "term")


def fit(docs: DataFrame, usable: Column, words: int = WORDS, grams: int = GRAMS) -> dict:
    """Languages, and the terms of words and of n-grams of each length."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    plain = known.select(F.col("lang").cast("string").alias("lang"), plain_words(F.col("text")).alias("text"))
    counts = stage(
        plain.mapInArrow(_count_batches, "lang STRING, word STRING, n BIGINT")
        .groupBy("lang", F.col("word").alias("term")).agg(F.sum("n").alias("n")),
        "language_words",
    )
    bounded = F.concat(F.lit("^"), "term", F.lit("$"))
    spans = F.expr(
        f"flatten(transform(sequence(1, {LONGEST}), k -> transform(sequence(1, greatest(char_length(b) - k + 1, 0)), "
        "i -> struct(k AS size, substring(b, i, k) AS gram))))"
    )
    spelled = stage(
        counts.select("lang", "n", bounded.alias("b")).select("lang", "n", F.explode(spans).alias("g"))
        .where("char_length(g.gram) = g.size").groupBy("lang", F.col("g.size").alias("size"), F.col("g.gram").alias("term"))
        .agg(F.sum("n").alias("n")),
        "language_grams",
    )
    every = counts.withColumn("size", F.lit(0)).unionByName(spelled)
    # One row per language and length.
    totals = every.groupBy("lang", "size").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(totals.lang))
    if not langs:
        return {"langs": []}
    place = {lang: i for i, lang in enumerate(langs)}
    while True:
        # Every language's counts of the terms that some language's vocabulary holds.
        chosen = (
            _vocabulary(counts, ["lang"], words).select(F.lit(0).alias("size"), "term")
            .union(_vocabulary(spelled, ["lang", "size"], grams).select("size", "term")).distinct()
        )
        held = stage(every.join(chosen, ["size", "term"]), "language_model")
        if held.count() <= ENTRIES or words <= 1:
            break
        words, grams = -(-words // 2), -(-grams // 2)
    found = held.toPandas()
    model = []
    for size in range(LONGEST + 1):
        full = np.zeros(len(langs))
        for lang, n in zip(*(totals[totals["size"] == size][c] for c in ("lang", "n"))):
            full[place[lang]] = n
        model.append(vars(_terms(found[found["size"] == size], full, place)))
    return {"langs": langs, "terms": model}


def unseen_word(word: str, grams: list[Terms], width: int) -> np.ndarray:
    """Mean log share of the word's longest known n-grams; even if none is known."""
    return unseen_words([word], grams, width, Powers())[0]


def unseen_words(words: list[str], grams: list[Terms], width: int, powers: Powers) -> np.ndarray:
    """A row of such means for every word; all words of a length of n-grams at once."""
    out, open_ = np.zeros((len(words), width)), range(len(words))
    for size in range(LONGEST, 0, -1):
        owner, pieces = [], []
        for i in open_:
            padded = f"^{words[i]}$"
            parts = [padded[j : j + size] for j in range(len(padded) - size + 1)]
            pieces += parts
            owner += [i] * len(parts)
        if not pieces:
            continue
        place = grams[size - 1].find(hash_terms(pieces, powers))
        hit = place >= 0
        owner = np.array(owner)[hit]
        total = np.zeros_like(out)
        grams[size - 1].add(total, owner, place[hit])
        known = np.bincount(owner, minlength=len(words))
        out += total / np.maximum(known, 1)[:, None]
        open_ = [i for i in open_ if not known[i]]
    return out


def _predict_batches(shared):
    def run(batches):
        langs, powers, memory = shared.value["langs"], Powers(), {}
        known, *grams = (Terms(**t) for t in shared.value["terms"])
        width = len(langs)
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            letters = np.asarray(batch.column("letters").fill_null(False))
            for low, high in row_chunks(bounds):
                block = data[bounds[low] : bounds[high]]
                start, end, own, first = _words(block, bounds[low : high + 1] - bounds[low], powers)
                unique, at, inverse = np.unique(own, return_index=True, return_inverse=True)
                row = np.repeat(np.arange(high - low), np.diff(first))
                place = known.find(unique)
                total, seen = np.zeros((high - low, width)), place[inverse] >= 0
                known.add(total, row[seen], place[inverse[seen]])
                if len(memory) * width > REMEMBERED:
                    memory.clear()
                raw = block.tobytes()
                missing = np.flatnonzero(place < 0)
                fresh = [i for i in missing if int(unique[i]) not in memory]
                words = [raw[start[at[i]] : end[at[i]]].decode("utf-8", "replace") for i in fresh]
                memory.update(zip(unique[fresh].tolist(), unseen_words(words, grams, width, powers)))
                if len(missing):
                    # A row's unseen words, each as often as it stands there.
                    number = np.full(len(unique), -1)
                    number[missing] = np.arange(len(missing))
                    scores = np.array([memory[code] for code in unique[missing].tolist()])
                    pair, times = np.unique(row[~seen] * len(missing) + number[inverse[~seen]], return_counts=True)
                    for k in range(width):
                        weight = scores[pair % len(missing), k] * times
                        total[:, k] += np.bincount(pair // len(missing), weight, minlength=len(total))
                total /= np.sqrt(np.maximum(np.diff(first), 1))[:, None]
                share = np.exp(total - total.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = share.argmax(axis=1)
                spoken = letters[low:high]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array([langs[b] if s else UNKNOWN for b, s in zip(best, spoken)], pa.string()),
                        pa.array(np.where(spoken, share[np.arange(len(best)), best], 0.0)),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text)``."""
    letters = F.col("text").rlike(r"\p{L}").alias("letters")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_words(F.col("text")).alias("text"), letters)
    if not model["langs"]:
        return texts.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(_predict_batches(shared), "doc_id BIGINT, lang_pred STRING, score DOUBLE")
