"""Personal data by patterns and by what reveals it (operator 5), in SQL functions only.

Patterns find e-mail and IP addresses, card and phone numbers. Those values are the
protected entities. A word discloses an entity as far as the corpus says so: with distinct
texts as the unit, pointwise mutual information

    PMI(entity, word) = log2(p(entity, word) / (p(entity) * p(word)))

is set against the entity's own information, IC(entity) = -log2 p(entity). A word whose
share PMI / IC reaches ``DISCLOSURE`` tells the entity almost as well as its own value
does. Two rare values that meet by chance reach it, too, so the meetings must also be
significant: the chance of as many texts with both, if words and entities were independent
(Hoeffding's bound of the hypergeometric tail), times the number of pairs, stays within
``SIGNIFICANT``. Every occurrence of such a word in a text that holds the entity is a span of
kind ``term``. Replacement puts a kind's label for a pattern's match, and for a term its
general form: the word's shape if it holds digits, else nothing.

All counts are of whole distinct texts, so copies of a text count once.

Offsets are code points. A null text counts as empty and has no spans; null and repeated
doc_ids keep their rows, as spans belong to the pair of doc_id and text.

Match positions come from the lengths of matches and of what ``split`` leaves between
them, so no function outside SQL is needed. The patterns are written so that Java's
matcher takes linear time and constant stack on any text: possessive or lookaround
forms of the plain patterns, with the same matches.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import stage

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.9
SIGNIFICANT = 0.01
NO_SPANS = "CAST(array() AS ARRAY<STRUCT<s: INT, o: INT, e: INT, kind: STRING>>)"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": ""}

_DOMAIN = (
    r"[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])[A-Za-z0-9.-]*?(?=\.\.|\.?[^A-Za-z0-9.-]|\.?\z)"
)
PATTERNS = {
    # A local part begins where no local character precedes, or where the last match ended.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@" + _DOMAIN,
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # On text in which separators not between two digits are masked.
    "card": r"[0-9][\x200-9-]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LONE_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
#: Stands for letters and digits of pattern matches, so that words that touch one are told.
MASK = "\uffff"
WORD = rf"[\p{{L}}\p{{N}}{MASK}][\p{{L}}\p{{N}}{MASK}'_-]*+"


def _matches(text: Column, pattern: str) -> Column:
    """Array of ``(s, e, v)``: start, end and text of every match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("v"))
    )
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, v: STRING>>)")

    def add(state, step):
        begin = state["at"] + step["gap"]
        stop = begin + F.char_length(step["v"])
        item = F.struct(begin.alias("s"), stop.alias("e"), step["v"].alias("v"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda x: x["out"])
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(_digits(value), ""))

    def part(digit, index):
        number = digit.cast("int")
        double = number * 2
        return F.when(index % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(number)

    return F.aggregate(F.transform(digits, part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets_fit(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (p.try_cast("int") <= 255))


_KEEP = {
    "email": lambda v: F.lit(True),
    "ip": _octets_fit,
    "card": lambda v: F.char_length(_digits(v)).between(14, 19) & _luhn(v),
    "phone": lambda v: F.char_length(_digits(v)).between(10, 15),
}
#: What a text must hold for a kind to be looked for.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    """Array of ``(s, o, e, kind, v)`` of all four kinds, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, o: INT, e: INT, kind: STRING, v: STRING>>)")

    def of_kind(order: int, kind: str) -> Column:
        # A separator outside a number is masked, one character for one.
        searched = F.regexp_replace(text, _LONE_SEPARATOR, "\x01") if kind == "card" else text
        kept = F.filter(_matches(searched, PATTERNS[kind]), lambda m: _KEEP[kind](m["v"]))
        named = F.transform(
            kept,
            lambda m: F.struct(
                m["s"].alias("s"), F.lit(order).alias("o"), m["e"].alias("e"), F.lit(kind).alias("kind"), m["v"].alias("v")
            ),
        )
        return F.when(text.rlike(_NEEDS[kind]), named).otherwise(empty)

    parts = [of_kind(order, kind) for order, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


# --- disclosure ---------------------------------------------------------------------


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def _masked(text: Column, spans: Column) -> Column:
    """The text with ``MASK`` for every letter and digit of a span, one for one."""

    def put(state, x):
        begin = F.greatest(x["s"], state["at"])
        inside = F.regexp_replace(F.substring(text, begin + 1, x["e"] - begin), r"[\p{L}\p{N}]", MASK)
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, begin - state["at"]), inside)
        return F.when(x["e"] <= state["at"], state).otherwise(F.struct(x["e"].alias("at"), piece.alias("out")))

    rest = lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, rest)).otherwise(text)


def find(docs: DataFrame) -> DataFrame:
    """``mark, spans, masked`` of every distinct text, stored; ``mark`` is the text's digest."""
    texts = docs.select(_mark(), F.coalesce("text", F.lit("")).alias("text")).groupBy("mark").agg(F.first("text").alias("text"))
    spanned = texts.withColumn("spans", base_spans(F.col("text")))
    # Whole texts: the largest of what is stored, so packed more tightly than usual.
    return stage(spanned.select("mark", "spans", _masked(F.col("text"), F.col("spans")).alias("masked")), "pii", compression="zstd")


def _log_chance(texts: Column, entity: Column, word: Column, both: Column) -> Column:
    """Bound of the log chance that independent values meet in ``both`` texts or more."""
    drawn, share = F.least(entity, word), F.greatest(entity, word) / texts
    part = both / drawn
    missed = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(0.0)
    return F.when(part > share, -drawn * (part * F.log(part / share) + missed)).otherwise(0.0)


def disclosing(found: DataFrame) -> DataFrame:
    """``mark, terms``: all occurrences of words that disclose an entity of their text."""
    words = F.array_distinct(
        F.transform(
            F.filter(F.regexp_extract_all("masked", F.lit(WORD), F.lit(0)), lambda w: ~F.contains(w, F.lit(MASK))), F.lower
        )
    )
    # Only counts are shuffled.
    common = stage(found.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("word_texts")), "pii_words")
    private = found.where(F.size("spans") > 0)
    held = stage(
        private.select("mark", F.array_distinct(F.transform("spans", lambda x: F.xxhash64(x["v"]))).alias("entities"), words.alias("words")),
        "pii_held",
    )
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("entity_texts"))
    texts = F.lit(found.count())
    tested = held.agg(F.sum(F.size("entities").cast("double") * F.size("words")).alias("n")).first()["n"] or 1.0
    limit = math.log(SIGNIFICANT) - math.log(max(tested, 1.0))
    most = entities.agg(F.max("entity_texts").alias("n")).first()["n"] or 1
    # Words that no number of meetings could make disclosing go before pairs are formed.
    met = F.least("word_texts", F.lit(most))
    possible = common.where(
        (met * F.log(F.col("word_texts") / texts) <= limit)
        & (F.log(F.col("word_texts") / met) <= (1 - DISCLOSURE) * F.log(texts))
    )
    named = held.select("mark", F.explode("words").alias("w")).join(possible, "w")
    owned = held.select("mark", F.explode("entities").alias("entity")).join(entities, "entity")
    pairs = owned.join(named, "mark").where(
        F.least("entity_texts", "word_texts") * F.log(F.greatest("entity_texts", "word_texts") / texts) <= limit
    )
    scored = (
        pairs.groupBy("entity", "w", "entity_texts", "word_texts").agg(F.count("*").alias("both"))
        .withColumn("ic", F.log2(texts / F.col("entity_texts")))
        .withColumn("pmi", F.log2(F.col("both") * texts / (F.col("entity_texts") * F.col("word_texts"))))
        .where((F.col("ic") > 0) & (F.col("pmi") >= F.col("ic") * DISCLOSURE))
        .where(_log_chance(texts, F.col("entity_texts"), F.col("word_texts"), F.col("both")) <= limit)
    )
    chosen = stage(scored.select("entity", "w"), "pii_pairs")
    told = (
        owned.join(chosen, "entity").select("mark", "w")
        .join(held.select("mark", F.explode("words").alias("w")), ["mark", "w"], "left_semi")
        .groupBy("mark").agg(F.collect_set("w").alias("told"))
    )
    return private.select("mark", "masked").join(told, "mark").select("mark", _occurrences(F.col("masked"), F.col("told")).alias("terms"))


def _occurrences(text: Column, told: Column) -> Column:
    """Spans of all words of ``text`` that are in ``told``."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.transform(F.split(text, WORD, -1), F.char_length)
    steps = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("v"))
    )

    def add(state, step):
        begin = state["at"] + step["gap"]
        stop = begin + F.char_length(step["v"])
        item = F.struct(begin.alias("s"), F.lit(len(KINDS)).alias("o"), stop.alias("e"), F.lit("term").alias("kind"))
        kept = F.when(F.array_contains(told, F.lower(step["v"])), F.concat(state["out"], F.array(item))).otherwise(state["out"])
        return F.struct(stop.alias("at"), kept.alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("out")), add, lambda x: x["out"])


def _spans_of_texts(docs: DataFrame) -> DataFrame:
    """``mark, base, spans`` of every distinct text with spans."""
    found = find(docs)
    base = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    private = found.where(F.size("spans") > 0).select("mark", base.alias("base"))
    # Written, so that AQE can split a text with very many copies in the joins with rows.
    return stage(
        private.join(disclosing(found), "mark", "left").select(
            "mark", "base", F.array_sort(F.concat("base", F.coalesce("terms", F.expr(NO_SPANS)))).alias("spans")
        ),
        "pii_spans",
    )


def all_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, base, spans`` for every row: pattern spans, and those with terms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark())
    return rows.join(_spans_of_texts(docs), "mark", "left").select(
        "doc_id", "mark", *(F.coalesce(c, F.expr(NO_SPANS)).alias(c) for c in ("base", "spans"))
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span's general form in its place; a span inside another goes with it."""

    def put(state, x):
        begin = F.greatest(x["s"], state["at"])
        label = reduce(lambda c, k: c.when(x["kind"] == k, F.lit(LABELS[k])), KINDS, F.when(F.lit(False), F.lit(""))).otherwise(
            F.regexp_replace(F.regexp_replace(F.substring(text, begin + 1, x["e"] - begin), r"[^0-9]", ""), "[0-9]", "0")
        )
        piece = F.concat(state["out"], F.substring(text, state["at"] + 1, begin - state["at"]), label)
        return (
            F.when(x["e"] <= state["at"], state)
            .otherwise(F.struct(x["e"].alias("at"), piece.alias("out")))
        )

    return F.when(
        F.size(spans) > 0,
        F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            put,
            lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.char_length(text))),
        ),
    ).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` generalised; rows, ids and other columns stay."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _mark())
    joined = rows.join(_spans_of_texts(docs).select("mark", "spans"), "mark", "left")
    text = F.col("row.text")
    text = F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans"))).alias("text")
    return joined.select(*(text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
