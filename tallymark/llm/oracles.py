"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

from tallymark.llm import chat, lattice, mixing, near_duplicates, repeated_text, url_trust, vantage

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _upper_to_lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op2() -> str:
    context = ", ".join(f"'{role}'" for role in chat.CONTEXT)
    return f"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(text, '') AS said,
               CASE WHEN coalesce(role, '') = '' THEN '{chat.UNKNOWN}' ELSE role END AS speaker,
               CAST(floor(turn / {chat.TURNS}) AS BIGINT) AS band
        FROM conversations),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, band ORDER BY turn, speaker, said) AS place FROM said),
    seen AS (
        SELECT p.*, s.perspective, CAST(floor((place - 1) / {chat.TURNS}) AS BIGINT) AS part,
               CASE WHEN p.speaker = s.perspective THEN '<|assistant|>'
                    WHEN p.speaker IN ({context}) THEN '<|' || p.speaker || '|>'
                    ELSE '<|user|>' || p.speaker || ': ' END AS head,
               said || '{chat.END}' AS body
        FROM placed p JOIN (SELECT DISTINCT conv_id, speaker AS perspective FROM said
                            WHERE speaker NOT IN ({context})) s
          ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
    measured AS (
        SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
                   PARTITION BY conv_id, perspective, band, part ORDER BY place
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
        FROM seen)
    SELECT conv_id, perspective, band, part, CAST(count(*) AS INTEGER) AS n_turns,
           string_agg(head || body || chr(10), '' ORDER BY place) AS text,
           coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY place)
               FILTER (WHERE speaker = perspective), '') AS mask
    FROM measured GROUP BY conv_id, perspective, band, part"""


def op3() -> str:
    weights = "[" + ", ".join(f"{w}.0::DOUBLE" for w in mixing.WEIGHTS) + "]"
    return f"""
    WITH quality AS (
        SELECT doc_id, CASE max(quality) WHEN 1 THEN {mixing.QUALITY[1]} WHEN 0 THEN {mixing.QUALITY[0]}
               ELSE {mixing.QUALITY[None]} END AS quality FROM labels GROUP BY doc_id),
    sized AS (
        SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, {_WORDS})), 0) AS size,
               -ln((('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
                   / CAST(coalesce(q.quality, {mixing.QUALITY[None]}) AS DOUBLE) AS key
        FROM documents d LEFT JOIN quality q USING (doc_id)),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               {weights}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INTEGER) + 1] AS w
        FROM sized GROUP BY source),
    levels AS (
        SELECT *, {mixing.CAP}.0 * source_size / w AS ratio,
               ({mixing.TOTAL} * sum(source_size) OVER () - coalesce(sum({mixing.CAP} * source_size) OVER (
                    ORDER BY {mixing.CAP}.0 * source_size / w, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (
                    ORDER BY {mixing.CAP}.0 * source_size / w, source NULLS LAST
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM sources),
    opened AS (
        SELECT max(level) AS level, min(ratio) AS ratio FROM levels WHERE level * w <= {mixing.CAP} * source_size),
    targets AS (
        SELECT source, source_size, CASE WHEN l.ratio < o.ratio THEN {mixing.CAP}.0 * source_size
               ELSE least({mixing.CAP}.0 * source_size, o.level * w) END::DOUBLE AS target
        FROM levels l, opened o),
    ranked AS (
        SELECT s.doc_id, s.size, t.source_size, t.target,
               CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
               sum(s.size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS before
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * CASE WHEN epochs >= {mixing.CAP} THEN {mixing.CAP} ELSE epochs + CASE
               WHEN before - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END END AS BIGINT) AS taken
    FROM ranked"""


def op4() -> str:
    n = near_duplicates.WORDS
    return f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({_upper_to_lower("coalesce(text, '')")}, {_WORDS}) AS w FROM documents),
    held AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS s
        FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM held a JOIN held b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        WHERE 100 * least(x.n, y.n) >= {near_duplicates.PERCENT} * greatest(x.n, y.n)
        GROUP BY a.doc_id, b.doc_id, x.n, y.n
        HAVING 100 * count(*) >= {near_duplicates.PERCENT} * (x.n + y.n - count(*))),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    labelled AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept
    FROM labelled LEFT JOIN sizes USING (doc_id)"""


def op10() -> str:
    host = _upper_to_lower(r"regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)")
    cases = {"rule": "", "by_rule": ""}
    for verdict, name, path in sorted(url_trust.RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{path}') THEN "
        cases["rule"] += f"{fits}'{name}{path}' "
        cases["by_rule"] += f"{fits}'{verdict}' "
    href = r"""[hH][rR][eE][fF][ \t\r\n]*=[ \t\r\n]*["'']?[A-Za-z][A-Za-z0-9+.-]*://([^/?#"''<> \t\r\n]*)"""
    d = url_trust.DAMPING
    steps = "".join(
        f"""
    r{k} AS MATERIALIZED (
        SELECT kind, host, sum(score) AS score FROM (
            SELECT kind, host, score FROM seeds
            UNION ALL SELECT f.kind, f.dst, f.share * r.score FROM flows f
            JOIN r{k - 1} r ON r.kind = f.kind AND r.host = f.src) GROUP BY kind, host),"""
        for k in range(1, url_trust.ITERATIONS + 1)
    )
    return f"""
    WITH RECURSIVE parts AS (
        SELECT page_id, {host} AS host, html,
               regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
    judged AS (
        SELECT *, CASE {cases["rule"]} END AS rule, CASE {cases["by_rule"]} END AS by_rule FROM parts),
    hosts AS (
        SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0.0 END) AS trust,
               avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
        FROM judged WHERE host <> '' GROUP BY host),
    family AS (
        SELECT host AS child, host[strpos(host, '.') + 1:] AS parent FROM hosts WHERE len(string_split(host, '.')) > 2
        UNION SELECT parent, parent[strpos(parent, '.') + 1:] FROM family WHERE len(string_split(parent, '.')) > 1
          AND len(string_split(parent, '.')) > 2),
    top AS (
        SELECT child, parent FROM family
        UNION SELECT parent, parent[strpos(parent, '.') + 1:] FROM family WHERE len(string_split(parent, '.')) = 2),
    targets AS (
        SELECT host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{href}', 1))) AS dst FROM parts),
    links AS (
        SELECT src, dst, sum(n) AS n FROM (
            SELECT src, {_upper_to_lower("dst")} AS dst, count(*) AS n FROM targets
            WHERE src <> '' AND dst <> '' AND src <> {_upper_to_lower("dst")} GROUP BY ALL
            UNION ALL SELECT child, parent, 1 FROM top UNION ALL SELECT parent, child, 1 FROM top) GROUP BY src, dst),
    ways AS (
        SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
    flows AS (
        SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) * {d} AS share FROM ways),
    seeds AS (
        SELECT 'trust' AS kind, host, trust * {1 - d} AS score FROM hosts WHERE trust > 0
        UNION ALL SELECT 'distrust', host, distrust * {1 - d} FROM hosts WHERE distrust > 0),
    r0 AS (SELECT * FROM seeds),{steps}
    ranks AS (
        SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust,
               sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust
        FROM r{url_trust.ITERATIONS} GROUP BY host)
    SELECT page_id, host, path, rule, coalesce(by_rule, CASE
        WHEN distrust > trust AND distrust >= {url_trust.LIMIT * (1 - d)} THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged LEFT JOIN ranks USING (host)"""


def op1() -> str:
    """Every window by its digest; texts as hexadecimal, two letters a byte."""
    w = repeated_text.WINDOW
    return f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
    windows AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * w})) AS m
        FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {w - 1})) AS i FROM texts)),
    twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY m) > 1),
    runs AS (SELECT r, min(i) AS low, max(i) + {w} AS high FROM (
        SELECT r, i, sum(gap) OVER (PARTITION BY r ORDER BY i) AS run FROM (
            SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {w} THEN 0 ELSE 1 END AS gap FROM twice))
        GROUP BY r, run),
    cut AS (SELECT r, count(*) AS n, sum(high - low) AS gone, max(high) AS rest,
               string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (low - coalesce(before, 0))), '' ORDER BY low) AS kept
        FROM (SELECT *, lag(high) OVER (PARTITION BY r ORDER BY low) AS before FROM runs) JOIN texts USING (r) GROUP BY r)
    SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
           sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * rest + 1) END)) AS kept_sha256
    FROM texts LEFT JOIN cut USING (r)"""


def op6() -> str:
    """All pairs of a label."""
    return f"""WITH RECURSIVE rows AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    sound AS (
        SELECT * FROM rows WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
          AND list_position(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x)), true) IS NULL
          AND list_position(list_transform(v, lambda x: x <> 0), true) IS NOT NULL),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= {lattice.COSINE}),
    reach AS (
        SELECT vec_id AS a, vec_id AS b FROM rows UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = reach.a) AS n_links,
           min(b) AS component_id, min(b) = a AS kept FROM reach GROUP BY a"""


def op13() -> str:
    """Every distance; equal where the relaxed search finds all neighbours."""
    return f"""WITH sound AS (
        SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_position(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true) IS NULL
          AND list_position(list_transform(embedding, lambda x: x <> 0), true) IS NOT NULL),
    away AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
        FROM (SELECT DISTINCT vec_id, v FROM sound WHERE vec_id % 100 = 0) q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
    FROM away QUALIFY rank <= {vantage.K}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_repeated_text": op1(),
        "op2_perspectives": op2(),
        "op3_mixing": op3(),
        "op4_near_duplicates": op4(),
        "op6_lattice": op6(),
        "op10_url_trust": op10(),
        "op13_nearest": op13(),
    }
