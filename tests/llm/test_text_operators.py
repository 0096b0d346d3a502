"""Corpus operators on small tables, against brute force."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import (
    bytehash,
    decontamination,
    language,
    mixing,
    near_duplicates,
    pii,
    repeated_text,
    toxicity,
)

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def frame(spark, texts, source=lambda i: "s"):
    rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng, words, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(words))


ODD = [None, "", " \t ", "x", "x"]


# --- operator 1 ---------------------------------------------------------------------


def covered(texts, window=repeated_text.WINDOW):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("small_shards", [False, True])
def test_repeated_passages_match_brute_force(spark, monkeypatch, small_shards):
    if small_shards:
        monkeypatch.setattr(repeated_text, "SHARD_BYTES", 20_000)
        monkeypatch.setattr(repeated_text, "ANCHOR_PIECES", 3)
        monkeypatch.setattr(repeated_text, "RANGE_WINDOWS", 700)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh éü\n") for _ in range(n))
    common, other, texts = text(700), text(450), []
    for i in range(30):
        body = text(rng.randrange(0, 1500))
        if i % 3 == 0:
            body = body[:300] + common[rng.randrange(0, 150) : rng.randrange(500, 700)] + body[300:]
        texts.append(body + other if i % 5 == 0 else body)
    texts += [texts[3], texts[3], texts[7] + "x", "a" * 1000, "ab" * 700 + "c", "a" * 399, texts[8] * 2, *ODD]
    rows = repeated_text.without_repeats(frame(spark, texts)).collect()
    found = {
        r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in rows
    }
    assert [found[i] for i in range(len(texts))] == covered(texts)


def test_repeated_passages_without_ids_are_found(spark):
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = text(600)
    texts = [f"{text(300)}{common}{text(300)}" for _ in range(3)] + [text(900)]
    docs = frame(spark, texts).withColumn("doc_id", F.lit(None).cast("long"))
    found = [(r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeated_text.without_repeats(docs).collect()]
    assert sorted(found) == sorted(covered(texts))


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for trial in range(12):
        size, letters = rng.choice([1, 50, 2000]), rng.choice([2, 4, 200])
        text = np.array([rng.randrange(letters) + 1 for _ in range(size)], np.uint8)
        if trial % 3 == 0 and size > 100:
            text[size // 2 : size // 2 + size // 4] = text[: size // 4]
        data, order = text.tobytes(), repeated_text.suffix_array(text)
        assert order.tolist() == sorted(range(size), key=lambda i: data[i:])
        shared = repeated_text.common_prefixes(text, order)
        for k in range(1, size):
            a, b = data[order[k - 1] :][:400], data[order[k] :][:400]
            assert shared[k] == next((m for m, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_merge_marks_digests_of_other_runs():
    shard = np.array([1, 1, 2, 2, 3, 3])
    digest = np.array([5, 9, 9, 4, 1, 5])
    assert repeated_text.merge_runs(shard, digest).tolist() == [True, True, True, False, False, True]
    assert repeated_text.merge_runs(shard[:0], digest[:0]).tolist() == []


# --- operator 3 ---------------------------------------------------------------------


def filled(sizes):
    """Targets by repeated sharing of what capped sources leave."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in free}}
        fixed.update({s: 2 * sizes[s] for s in over})


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(300)] + ODD
    names = ["a", "b", "é", "𝒳", "￮", None]
    docs = frame(spark, texts, lambda i: names[0] if i % 3 == 0 else names[i % 6])
    weights = spark.createDataFrame([(i, float(1 + i % 2)) for i in range(0, 300, 5)], "doc_id LONG, quality DOUBLE")
    rows = mixing.plan(docs, weights).collect()
    assert len(rows) == len(texts)
    own = collections.defaultdict(list)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.taken <= 2 * r.size
        own[r.source].append(r)
    expected = filled({s: sum(r.size for r in rs) for s, rs in own.items()})
    for source, rs in own.items():
        (target,) = {r.target for r in rs}
        assert target == pytest.approx(expected[source])
        assert abs(sum(r.taken for r in rs) - expected[source]) <= max(r.size for r in rs) / 2 + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.plan(docs, weights).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    assert mixing.mixed(docs).count() == sum(r.taken // r.size for r in mixing.plan(docs).collect() if r.size)
    assert mixing.plan(docs.limit(0)).count() == 0


def test_documents_without_ids_draw_apart(spark, monkeypatch):
    """A third of the rows has no id, most are labelled bad; no key range is much larger than expected."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rng = random.Random(11)
    rows = [(None if i % 3 == 0 else i, prose(rng, rng.randrange(1, 30)), "big" if i % 7 else None, i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, key INT").repartition(3)
    weights = spark.createDataFrame([(i, 0.5) for i in range(900) if i % 5], "doc_id LONG, quality DOUBLE")
    slices = []
    staged = mixing.stage

    def seen(frame, name):
        stored = staged(frame, name)
        if name == "mix_slices":
            slices.extend(r["count"] for r in stored.groupBy("source", "slice").count().collect())
        return stored

    monkeypatch.setattr(mixing, "stage", seen)
    found = mixing.plan(docs, weights).collect()
    again = mixing.plan(docs, weights).collect()
    assert len(found) == 900 and sorted(map(str, found)) == sorted(map(str, again))
    assert max(slices) <= 4 * mixing.RANGE_ROWS
    for source in ("big", None):
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 2 * r.size for r in own)


# --- operator 4 ---------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [(len(s), k) for s, k in zip(sets, label)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    passage = prose(rng, 60, 5000)
    texts: list = []
    for i in range(25):
        words = prose(rng, rng.choice([3, 8, 30, 110, 400]), 5000).split()
        for k in range(4):
            edited = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 30)):
                edited[rng.randrange(len(edited))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(edited).upper() if k == 1 else " ".join(edited))
    base = prose(rng, 150, 5000).split()
    for _ in range(30):  # a family whose members differ from each other more than from its base
        edited = list(base)
        for _ in range(3):
            edited[rng.randrange(150)] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(edited))
    texts += [prose(rng, 60, 5000) + " " + passage for _ in range(20)]
    texts += [texts[5], texts[5], *ODD]
    rows = {r.doc_id: r for r in near_duplicates.near_duplicates(frame(spark, texts)).collect()}
    for i, (size, component) in enumerate(groups(texts)):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (size, component, component == i)


def test_near_duplicates_without_rows_or_ids(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f"])
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.component_id, r.kept) for r in near_duplicates.near_duplicates(unnamed).collect()] == [(None, True)] * 2


# --- operator 5 ---------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    """The patterns as they are stated, by Python's engine."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    ]
    found = [
        (m.start(), order, kind, m.end())
        for order, (kind, pattern, keep) in enumerate(kinds)
        for m in re.finditer(pattern, text or "")
        if keep(m[0])
    ]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_pattern_spans_match_plain_patterns(spark):
    rng = random.Random(11)
    parts = ["a@b.co", "x_", "@", "..", ".", "-", " ", "1", "23", "255.1.2.3", "256.1.1.1", "+1 (555) 010-9999", "+",
             "4111 1111 1111 1111", "4111-1111-1111-1111", "4012888888881881", "é", "𝒳", "(", "%", "q.r@s.t.u", "\n", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    texts += ["1 " * 30_000, "a" * 50_000, "9" * 50_000, "a@b" + ".c" * 20_000, "+1" * 20_000, "1." * 20_000, "a@b..c@d.e_f@g.h", *ODD]
    spans = frame(spark, texts).select("doc_id", pii.span_text(pii.base_spans(F.col("text"))).alias("s"))
    found = {r.doc_id: r.s for r in spans.collect()}
    for i, text in enumerate(texts):
        assert found[i] == plain_spans(text), text[:200] if text else text


def test_terms_that_disclose_are_generalised(spark):
    rng = random.Random(2)
    texts = [f"{prose(rng, 20)} zorblax ask zed{i}@mail.example {prose(rng, 20)}" for i in range(3)]
    texts += [f"{prose(rng, 15)} Quixley 77-b writes boss@corp.example {prose(rng, 15)}" for _ in range(6)]
    texts += [prose(rng, 40) for _ in range(60)] + ODD
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in pii.all_spans(docs).collect()}
    marked = {texts[i][s.s : s.e].lower() for i, r in rows.items() for s in r.spans if s.kind == "term"}
    assert "quixley" in marked and "zorblax" not in marked
    assert not any(r.spans for i, r in rows.items() if i >= 9)
    clean = {r.doc_id: r for r in pii.sanitise(docs.withColumn("spans", F.lit(1)).withColumn("_mark", F.lit(2))).collect()}
    assert len(clean) == len(texts) and clean[4]["spans"] == 1
    assert "[EMAIL]" in clean[4].text and "boss@" not in clean[4].text and "Quixley" not in clean[4].text
    assert [clean[i].text for i in range(9, len(texts))] == texts[9:]
    assert pii.all_spans(docs.limit(0)).count() == 0


def test_terms_are_generalised_wherever_they_stand(spark):
    rng = random.Random(21)
    texts = [f"Quixley {prose(rng, 60)} boss@corp.example {prose(rng, 60)} quixley x" for _ in range(3)]
    texts += [texts[0]] + [prose(rng, 60) for _ in range(300)]
    texts += [f"{prose(rng, 60)} unique{i} ann{i}@mail.example" for i in range(5)]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, texts)).collect()}
    assert all("uixley" not in clean[i] and "[EMAIL]" in clean[i] for i in range(4))
    assert all(f"unique{i} [EMAIL]" in clean[304 + i] for i in range(5))
    assert [clean[i] for i in range(4, 304)] == texts[4:304]


# --- operator 7 ---------------------------------------------------------------------


def test_languages_are_told_apart(spark):
    rng = random.Random(4)
    stems = {"xx": ["ka", "lo", "mi"], "yy": ["été", "où", "çe"], "zz": ["schr", "ung", "keit"]}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 5)))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang) for i in range(90) for lang in [list(stems)[i % 3]]]
    rows += [(100, None, "xx"), (101, "", None), (102, "12 34 %%", "yy"), (103, "KALOMI", None), (None, "ung keit", None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING").repartition(3)
    model = language.fit(docs, usable=F.col("doc_id") % 4 != 2)
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:90])
    assert [found[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "xx", "zz"]
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = language.fit(docs, usable=F.lit(False))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def terms(scores, width=2):
    """A table in which the languages' scores of each term are given."""
    names = sorted(scores, key=lambda t: int(bytehash.hash_terms([t])[0]))
    hashes = bytehash.hash_terms(names) if names else np.empty(0, np.uint64)
    gain = np.array([x for n in names for x in scores[n]], float)
    return language.Terms(hashes, np.arange(len(names) + 1) * width, np.tile(np.arange(width), len(names)), gain, np.zeros(width))


def test_unseen_words_fall_back():
    grams = [terms({"k": [-1.0, -5.0]}), terms({"ka": [-2.0, -9.0]}), terms({}), terms({})]
    assert language.unseen_word("kaz", grams, 2).tolist() == [-2.0, -9.0]
    assert language.unseen_word("xkx", grams, 2).tolist() == [-1.0, -5.0]
    assert language.unseen_word("q", grams, 2).tolist() == [0.0, 0.0]


def plain_language_scores(rows, asked):
    """Shares of languages by the definition, with every word and n-gram in the vocabulary."""
    split = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    words, grams = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for w in split(text):
            words[lang][w] += 1
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    grams[lang, k][f"^{w}$"[i : i + k]] += 1
    langs = sorted(words)

    def share(table, lang, key, term):
        vocabulary = len({t for other in langs for t in table[key(other)]})
        own = table[key(lang)]
        return math.log((own[term] + 0.1) / (sum(own.values()) + 0.1 * vocabulary))

    def score(lang, w):
        if any(w in words[x] for x in langs):
            return share(words, lang, lambda x: x, w)
        for k in range(4, 0, -1):
            found = [g for i in range(len(w) + 3 - k) if any((g := f"^{w}$"[i : i + k]) in grams[x, k] for x in langs)]
            if found:
                return sum(share(grams, lang, lambda x: (x, k), g) for g in found) / len(found)
        return 0.0

    out = []
    for text in asked:
        own = split(text)
        total = np.array([sum(score(x, w) for w in own) for x in langs]) / math.sqrt(len(own))
        part = np.exp(total - total.max())
        out.append((langs[int(part.argmax())], float(part.max() / part.sum())))
    return out


def test_scores_follow_the_definition(spark):
    rng = random.Random(12)
    letters = {"el": "αβγδε", "en": "abcde", "ru": "абвгд"}
    word = lambda lang: "".join(rng.choice(letters[lang] + "xy") for _ in range(rng.randrange(1, 5)))
    rows = [(" ".join(word(lang) for _ in range(rng.randrange(1, 25))).title(), lang) for lang in rng.choices(list(letters), k=60)]
    asked = [f"\u201c{word(a)}\u00a0{word(b)}\u2014{word(a).upper()}7{word(a)}\u2019" for a in letters for b in letters for _ in range(4)]
    docs = spark.createDataFrame([(i, t, x, "clash") for i, (t, x) in enumerate(rows)], "doc_id LONG, text STRING, lang STRING, letters STRING")
    model = language.fit(docs.repartition(3), usable=F.lit(True))
    texts = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(asked)], "doc_id LONG, text STRING, letters STRING")
    found = {r.doc_id: r for r in language.predict(texts, model).collect()}
    for i, (lang, score) in enumerate(plain_language_scores(rows, asked)):
        assert found[i].lang_pred == lang and abs(found[i].score - score) < 1e-6
    assert language.predict(texts.limit(0), model).count() == 0


def test_many_languages_and_rare_words_keep_their_counts(spark, monkeypatch):
    """No language is left out, and a word beyond a language's own list has its count there."""
    own = lambda n: chr(97 + n // 26) + chr(97 + n % 26)
    rows = [(n, f"common{own(n)} " * 9 + "loan", f"l{n:02d}") for n in range(70)]
    rows += [(100 + n, f"often{own(n % 20)} " * 30 + "thing " * (n % 2), "zz") for n in range(400)]
    rows += [(600 + n, "thing", "aa") for n in range(9)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    # Twenty words of zz come before its "thing", which only aa has in its list.
    model = language.fit(docs, F.lit(True), words=20, grams=20)
    zz = model["langs"].index("zz")
    known = language.Terms(**model["terms"][0])
    place = int(known.find(bytehash.hash_terms(["thing"]))[0])
    gain = dict(zip(known.lang[known.begin[place] : known.begin[place + 1]], known.gain[known.begin[place] : known.begin[place + 1]]))
    assert len(model["langs"]) == 72 and abs(gain[zz] - math.log1p(200 / language.SMOOTHING)) < 1e-6
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert all(found[n] == f"l{n:02d}" for n in range(70))
    monkeypatch.setattr(language, "ENTRIES", 100)
    assert len(language.fit(docs, F.lit(True))["langs"]) == 72


# --- operator 8 ---------------------------------------------------------------------


def test_best_passage_matches_dynamic_programming():
    rng = random.Random(9)
    for _ in range(150):
        item = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 120)))
        text = text[:20] + item[:5] + item[6:] + text[20:]
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        assert decontamination.best_passage(item, text, 10**6)[0] == min(row)


def test_edited_items_are_found(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 30, 3000)) for i in range(20)] + [(20, "too short"), (21, None), (0, None)]
    benchmark = spark.createDataFrame(items, "item_id LONG, text STRING")
    texts, expected = [], set()
    for i in range(60):
        body = prose(rng, 100, 3000)
        if i % 2:
            number, item = items[i % 20]
            chars = list(item)
            allowed = decontamination.budget(decontamination.normalise(item))
            for _ in range(allowed if i % 4 == 1 else 3 * allowed):
                chars[rng.randrange(len(chars))] = "Q"
            if i % 4 == 1:
                expected.add((i, number))
            body = f"{body[:200]} {''.join(chars).upper()} -- {body[200:]}"
        texts.append(body)
    docs = frame(spark, texts + ODD)
    found = decontamination.contaminated(docs, benchmark).collect()
    assert expected <= {(r.doc_id, r.item_id) for r in found}
    assert all(r.distance <= r.budget for r in found)
    for r in found:  # each by a full alignment of item and document
        item, text = decontamination.normalise(items[r.item_id][1]), decontamination.normalise(texts[r.doc_id])
        assert decontamination.best_passage(item, text, r.budget)[0] == r.distance
    kept = {r.doc_id for r in decontamination.decontaminated(docs, benchmark).collect()}
    assert kept == set(range(65)) - {r.doc_id for r in found}
    short = frame(spark, ["it is Too,  SHORT here", "to short", prose(rng, 20, 3000)])
    assert [r.item_id for r in decontamination.contaminated(short, benchmark).collect()] == [20]
    assert decontamination.contaminated(short, benchmark, least_chars=10).count() == 0
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), benchmark).count() == 0


# --- operator 9 ---------------------------------------------------------------------


def segments(scores):
    """Maximal segments by their recursive definition."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = math.fsum(scores[i:j])
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j)
    if best is None:
        return []
    total, i, j = best
    return segments(scores[:i]) + [(i, j, total)] + [(a + j, b + j, s) for a, b, s in segments(scores[j:])]


def test_maximal_segments_match_definition():
    rng = random.Random(8)
    for _ in range(150):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() * 0.01 for _ in range(rng.randrange(0, 22))]
        rounded = lambda found: [(a, b, round(s, 6)) for a, b, s in found]
        assert rounded(toxicity.maximal_segments(np.array(scores))) == rounded(segments(scores))


def test_toxic_documents_are_told_apart(spark):
    rng = random.Random(12)
    bad = ["vilething", "grotword", "slurria", "slurrio", "slurriam"]
    texts, toxic = [], []
    for i in range(400):
        words = prose(rng, 60, 150).split()
        if i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words))
        toxic.append(int(i % 5 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id LONG, quality INT, toxic INT")
    docs = frame(spark, texts + ["Slurrius, grotword! " + prose(rng, 40, 150), *ODD])
    model = toxicity.fit(docs, labels, usable=F.col("doc_id") % 4 != 0)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = range(0, 400, 4)
    right = sum((rows[i].score >= 0.5) == bool(toxic[i]) for i in held)
    assert right >= 0.97 * len(held)
    assert rows[400].score >= 0.5
    span = rows[400].passages[0]
    assert "grotword" in (texts + ["Slurrius, grotword! "])[400].encode()[span.start : span.stop].decode()
    assert all(rows[i].score < 0.5 and not rows[i].passages for i in range(401, 406))
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, none).collect()} == {True}


def test_toxic_passages_after_isolated_uses_are_found(spark):
    rng = random.Random(31)
    bad = ["vilething", "grotword", "slurria", "blargous"]
    texts = []
    for i in range(400):
        words = prose(rng, 60, 150).split()
        if i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id LONG, quality INT, toxic INT")
    isolated = " ".join(f"{prose(rng, 40, 150)} {word}" for word in bad * 2)
    dense = " ".join(bad)
    long = f"{isolated} {prose(rng, 80, 150)} {dense} {prose(rng, 80, 150)} {dense} {prose(rng, 80, 150)}"
    docs = frame(spark, [*texts, long])
    row = toxicity.score(docs, toxicity.fit(docs, labels)).where("doc_id = 400").first()
    at = [m.start() for m in re.finditer(dense, long)]
    assert len(at) == 2 and row.score >= 0.5
    for begin in at:
        assert any(s.start <= begin and begin + len(dense) <= s.stop for s in row.passages)


def test_repeats_count_less_only_inside_a_stretch():
    rng = random.Random(14)
    for _ in range(60):
        words = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 40))])
        scores = np.array([rng.choice([4.0, 2.0, -1.0, 3.0, -2.0])] * 5)[words] + np.where(words == 0, -3.0, 0.5)
        best = max(
            toxicity._damped(scores[i:j], words[i:j], np.zeros(j - i)).sum()
            for i in range(len(words)) for j in range(i + 1, len(words) + 1)
        )
        assert toxicity.stretch_score(scores, words) <= max(best, scores.max()) + 1e-9
    assert toxicity.stretch_score(np.full(4, 3.0), np.arange(4)) == 12
    assert toxicity.stretch_score(np.full(4, 3.0), np.zeros(4)) == pytest.approx(3 * (1 + 1 / 2 + 1 / 3 + 1 / 4))
    apart = np.full(84, -1.0)
    apart[[0, 1, 2, 81, 82, 83]] = 40.0
    assert toxicity.stretch_score(apart, np.array([0, 1, 2, *[9] * 78, 0, 1, 2])) >= 120


# --- words --------------------------------------------------------------------------


def test_words_are_split_and_hashed_as_bytes():
    import pyarrow as pa

    texts = ["a  b\tc", "", None, "é\x1fü x\x0b y", "last"]
    data, bounds = bytehash.utf8(pa.array(texts))
    hashes, first = bytehash.word_hashes(data, bounds, bytehash.Powers())
    words = [(t or "").encode().split() for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    assert hashes.tolist() == bytehash.hash_terms([x.decode() for w in words for x in w]).tolist()


def test_stored_texts_are_packed_tightly(spark):
    found = pii.find(frame(spark, ["mail me at a.b@c.de", "nothing here", None]))
    assert found.count() == 3
    files = found.inputFiles()
    assert files and all(name.endswith(".zstd.parquet") for name in files)
