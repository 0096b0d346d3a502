"""Vector, page and conversation operators, and the pipeline, on small tables."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import chat, components, lattice, url_trust

# --- components ---------------------------------------------------------------------


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, 500)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(links)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a LONG, b LONG")).collect()}
    assert found == {n: c for n, c in label.items() if n != 500 and (n != c or list(label.values()).count(c) > 1)}
    assert components.components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


# --- operator 6 ---------------------------------------------------------------------


def test_decoding_finds_the_nearest_lattice_point():
    x = np.random.default_rng(1).standard_normal((400, 8)) * 2
    point, neighbours = lattice.nearest_point(x), lattice.shortest_vectors()
    assert neighbours.shape == (240, 8) and np.allclose((neighbours**2).sum(1), 2)
    distance = ((x - point) ** 2).sum(1)
    assert distance.max() <= 1 + 1e-9
    for v in neighbours:
        assert (((x - point - v) ** 2).sum(1) >= distance - 1e-9).all()


@pytest.mark.parametrize("block", [2_048, 5])
def test_linked_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((25, 32))
    rows = []
    for i in range(200):
        v = centres[i % 25] + rng.standard_normal(32) * rng.choice([0.05, 0.2, 0.9])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(200 + k, rows[4][1], rows[4][2]) for k in range(6)] + [(210, [2 * x for x in rows[5][1]], rows[5][2])]
    bad = [None, [], [0.0] * 32, [1.0, None], [float("nan")] * 32, [float("inf")] + [1.0] * 31]
    rows += [(220 + k, v, 1) for k, v in enumerate(bad)] + [(230, rows[6][1], None), (231, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT").withColumn("node", F.lit("x"))
    found = {r.vec_id: r for r in lattice.linked_vectors(table.repartition(4)).collect()}
    good = {i: (np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and i not in range(220, 226)}
    links = collections.defaultdict(set)
    for i, (v, a) in good.items():
        for j, (w, b) in good.items():
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= lattice.COSINE:
                links[i].add(j)
    right = sum(found[i].n_links == len(links[i]) for i, _, _ in rows)
    total, hit = sum(map(len, links.values())), sum(r.n_links for r in found.values())
    assert hit <= total and hit >= 0.98 * total and right >= 0.97 * len(rows)
    assert all(found[i].component_id == i and found[i].kept and not found[i].n_links for i in (*range(220, 226), 230))
    assert lattice.linked_vectors(table.limit(0)).count() == 0


# --- operator 10 --------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def plain_rule(host, path):
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in url_trust.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_trust(spark):
    urls = [
        "http://a.example.com/en/1", "https://www.example.com/en/2?x", "http://A.COM", "http://com/", "x://b.net/es/#q",
        "http://b.net/de/1", "http://b.net/fr/2", "http://c.net/de/", "http://friend.org/", "http://farm.org/?u=http://com/",
        None, "", "no scheme", "://", "http://notcom/", "http://a.com?/en/", "http://é.com/x", "http://b.net/de/1",
    ]
    html = {8: '<a href="http://a.com/x">', 9: "<A HREF = 'https://B.net/es/1'> <a href=/local>", 7: None}
    pages = spark.createDataFrame([(i, u, html.get(i, "")) for i, u in enumerate(urls)], "page_id LONG, url STRING, html STRING")
    rows = {r.page_id: r for r in url_trust.verdicts(pages.withColumn("rule", F.lit(0)).repartition(3)).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert verdict is None or rows[i].verdict == verdict
    assert rows[5].verdict == "block"  # most pages of its host are blocked
    assert rows[9].verdict == "block"  # links to a mostly blocked host only
    assert rows[7].verdict == rows[8].verdict == rows[10].verdict == "allow"
    assert url_trust.verdicts(pages.limit(0)).count() == 0


def test_ranks_match_power_iteration(spark):
    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(12)]
    links = {(rng.choice(hosts), rng.choice(hosts)): rng.randrange(1, 4) for _ in range(30)}
    seeds = {h: (rng.random(), rng.random() if i % 2 else 0.0) for i, h in enumerate(hosts[:6])}
    found = {
        r.host: (r.trust, r.distrust)
        for r in url_trust.host_ranks(
            spark.createDataFrame([(h, a, b) for h, (a, b) in seeds.items()], "host STRING, allowed DOUBLE, blocked DOUBLE"),
            spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src STRING, dst STRING, n LONG"),
        ).collect()
    }
    for k, flip in ((0, False), (1, True)):
        ways = {((b, a) if flip else (a, b)): n for (a, b), n in links.items()}
        out = collections.Counter()
        for (a, _), n in ways.items():
            out[a] += n
        rest = {h: (1 - url_trust.DAMPING) * v[k] for h, v in seeds.items()}
        rank = dict(rest)
        for _ in range(url_trust.ITERATIONS):
            new = collections.Counter(rest)
            for (a, b), n in ways.items():
                new[b] += url_trust.DAMPING * n / out[a] * rank.get(a, 0.0)
            rank = new
        for h in hosts:
            assert found.get(h, (0.0, 0.0))[k] == pytest.approx(rank.get(h, 0.0))


# --- operator 2 ---------------------------------------------------------------------


def test_every_speaker_gets_a_rendering(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 3)
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("system", "be kind"), ("ann", "hi"), ("bob", "yo 𝒳"), ("ann", None), ("cy", "é"), ("bob", "bye")])]
    rows += [(1, 5, "bob", "bye"), (1, None, "", "late"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 7, None, "?")]
    rows += [(4, 1, "ann", f"t{i:02}") for i in range(8)]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").withColumn("part", F.lit(9))
    parts = collections.defaultdict(list)
    for r in chat.rendered(turns.repartition(3)).collect():
        assert r.n_turns <= 3
        parts[r.conv_id, r.perspective].append(r)
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append((turn is None, turn or 0, role or "unknown", text or ""))
    expected = {(c, s) for c, ts in said.items() for _, _, s, _ in ts if s not in chat.CONTEXT}
    assert set(parts) == expected
    for (conv, me), own in parts.items():
        own.sort(key=lambda r: (r.band is None, r.band or 0, r.part))
        text, learned = "".join(r.text for r in own), [r.text[s.start : s.stop] for r in own for s in r.mask]
        plain = ""
        for _, _, who, what in sorted(said[conv]):
            head = "<|assistant|>" if who == me else f"<|{who}|>" if who in chat.CONTEXT else f"<|user|>{who}: "
            plain += f"{head}{what}<|end|>\n"
        assert text == plain
        assert learned == [f"{x}<|end|>" for _, _, who, x in sorted(said[conv]) if who == me]
    assert chat.rendered(turns.limit(0)).count() == 0


def test_bands_without_numbers_span_ranges(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 4)
    rows = [(7, None, "ann" if i % 3 else "bob", f"text {i:03}") for i in range(120)] + [(7, 2, "bob", "again")] * 30
    rows += [(None, None, "ann", f"t{i}") for i in range(40)] + [(8, i, "cy", "x" * i) for i in range(30)]
    turns = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").repartition(5)
    own = turns.select("conv_id", "turn", F.col("role").alias("speaker"), F.col("text").alias("said"))
    placed = chat._placed(own.withColumn("band", F.floor(F.col("turn") / chat.TURNS))).collect()
    bands = collections.defaultdict(list)
    for r in placed:
        bands[r.conv_id, r.band].append((r.place, (r.turn is None, r.turn or 0, r.speaker, r.said)))
    assert len(placed) == len(rows)
    for band in bands.values():
        band.sort()
        assert [p for p, _ in band] == list(range(1, len(band) + 1))
        assert [r for _, r in band] == sorted(r for _, r in band)
    parts = chat.rendered(turns).where("conv_id = 7 AND perspective = 'ann'").collect()
    assert sum(r.n_turns for r in parts) == 150 and max(r.n_turns for r in parts) == 4


# --- pipeline -----------------------------------------------------------------------


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    prose = lambda n, stock=2000: " ".join(f"w{rng.randrange(stock)}" for _ in range(n))
    item = prose(30)
    texts = [prose(80) + (" vilething grotword slurria vilething" if i % 6 == 0 else "") for i in range(120)]
    texts[7] = texts[7] + " " + item
    texts[8] = texts[8] + " mail me at ann@mail.example"
    texts += [texts[1] + " extra", texts[3]]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(200, None, None, None, None)]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"),
        "labels": spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id LONG, quality INT, toxic INT"),
        "benchmark": spark.createDataFrame([(0, item)], "item_id LONG, text STRING"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == tables["documents"].columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i in range(120) if i % 6} | {200}
    assert kept["toxicity"] == clean | {120, 121}
    assert kept["near_duplicates"] == clean
    assert kept["decontamination"] == clean - {7}
    assert kept["pii"] == clean - {7}
    assert docs.where("doc_id = 8").first().text.endswith("mail me at [EMAIL]")
    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mix} == clean - {7}
    assert all(r.taken <= 2 * r.size for r in mix)


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    one, two, three, item = prose(120), prose(120), prose(120), prose(30)
    kind = "doc_id LONG, text STRING"
    rows = [(1, one), (1, one), (1, two), (None, two), (None, three), (None, three), (4, None), (4, None)]
    kept = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, kind).repartition(3), str(tmp_path))
    order = lambda found: sorted(found, key=repr)
    assert order(map(tuple, kept.collect())) == order([(1, one), (1, two), (None, three), (4, None), (4, None)])
    spark.createDataFrame([(0, item)], "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{one} {item}"), (None, one), (2, f"{two} {item}"), (2, two), (3, None)]
    kept = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(rows, kind), str(tmp_path))
    assert order(map(tuple, kept.collect())) == order([(None, one), (2, two), (3, None)])
