"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

from . import secrets


def _op9() -> str:
    def spans(i: int, r: secrets.Rule) -> str:
        pattern = r.pattern.replace("'", "''")
        flags = "gi" if r.ignore_case else "g"
        kept = f"regexp_extract(p.x, '{pattern}', {r.group}{', ' + repr('i') if r.ignore_case else ''})"
        return f"""
        SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, p.i AS i, p.x AS x, p.before AS s, p.before + length(p.x) AS e
        FROM (SELECT doc_id, string_split(regexp_replace(body, '{pattern}', chr(1) || '\\0' || chr(1), '{flags}'), chr(1)) AS parts FROM d) m,
             LATERAL (SELECT unnest(range(len(parts))) + 1 AS i, unnest(parts) AS x,
                             unnest(list_transform(range(len(parts)), lambda k: coalesce(list_sum(list_transform(parts[1:k], lambda y: length(y))), 0)))::BIGINT AS before) p
        WHERE p.i % 2 = 0 AND length({kept}) >= {r.min_length}"""

    rules = secrets.BASE_RULES + secrets.EXTRA_RULES
    unions = " UNION ALL ".join(spans(i, r) for i, r in enumerate(rules))
    n_base = len(secrets.BASE_RULES)
    counts = ", ".join(f"count(h.kind) FILTER (h.ord = {i}) AS n_{r.kind}" for i, r in enumerate(rules[:n_base]))
    listed = "string_agg(h.kind || ':' || h.s || ':' || h.e, ',' ORDER BY h.s, h.ord)"
    return f"""
    WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS body FROM documents),
    h AS ({unions})
    SELECT d.doc_id, {counts},
           sha256(coalesce({listed} FILTER (h.ord < {n_base}), '')) AS base_sha256,
           coalesce({listed}, '') AS spans
    FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id"""


def _op7() -> str:
    def bits(*parts: str) -> str:
        return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT"

    return f"""
    WITH sized AS (SELECT source, sum(length(text))::DOUBLE AS size FROM documents GROUP BY source),
    rates AS (SELECT source, (SELECT sum(size) FROM sized) * pow(size, 0.7) / (SELECT sum(pow(size, 0.7)) FROM sized) / size AS rate FROM sized),
    cdf AS (
        SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM (SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 12)::BIGINT + 1)) AS k FROM rates)),
    lists AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
    drawn AS (
        SELECT doc_id, source, length(text) AS n_chars,
               len(list_filter(cs, lambda c: c <= {bits("'11'", "'count'", "doc_id::VARCHAR")} / 4503599627370496.0)) AS n
        FROM documents JOIN lists USING (source)),
    copies AS (SELECT doc_id, source, n_chars, unnest(range(1, n + 1)) AS copy FROM drawn)
    SELECT doc_id, source, n_chars, copy::INTEGER AS copy,
           {bits("'11'", "'order'", "doc_id::VARCHAR", "copy::VARCHAR")} AS shuffle_key
    FROM copies"""


def _op8() -> str:
    return r"""
    WITH l AS (
        SELECT doc_id, i - 1 AS line_no, line FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    able AS (SELECT * FROM l WHERE regexp_matches(line, '\S')),
    d AS (SELECT line, min(doc_id * 1000000000 + line_no) AS first, length(line) AS n FROM able GROUP BY line),
    halves AS (
        SELECT line, first, n, n - longer AS short, longer, side,
               CASE side WHEN 0 THEN left(line, ((n - longer) // 2)::BIGINT) ELSE right(line, ((n - longer) // 2)::BIGINT) END AS half
        FROM d, (VALUES (0), (1)) a(longer), (VALUES (0), (1)) b(side)),
    near AS (
        SELECT DISTINCT a.line FROM halves a JOIN halves b USING (side, short, half)
        WHERE b.first < a.first AND a.n >= 20 AND b.n >= 20 AND levenshtein(a.line, b.line) <= 1),
    judged AS (
        SELECT l.doc_id, l.line_no, l.line, d.first IS NOT NULL AND d.first <> l.doc_id * 1000000000 + l.line_no AS equal,
               d.first = l.doc_id * 1000000000 + l.line_no AND near.line IS NOT NULL AS near
        FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (equal) AS n_equal, count(*) FILTER (near) AS n_near,
           md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT equal AND NOT coalesce(near, false)), '')) AS kept_md5
    FROM judged GROUP BY doc_id"""


def _op3() -> str:
    return r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
    reps AS (SELECT array_to_string(words, ' ') AS body, any_value(words) AS words, min(doc_id) AS copy_of FROM w GROUP BY 1),
    sh AS (
        SELECT DISTINCT copy_of, array_to_string(words[i : i + 4], ' ') AS s
        FROM (SELECT copy_of, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM reps WHERE len(words) > 0)),
    sizes AS (SELECT copy_of, count(*) AS n FROM sh GROUP BY 1),
    common AS (SELECT a.copy_of AS a, b.copy_of AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.copy_of <> b.copy_of GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.copy_of = a JOIN sizes y ON y.copy_of = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
    reach AS (SELECT copy_of AS a, copy_of AS b FROM reps UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    classes AS (SELECT a AS copy_of, min(b) AS class_id FROM reach GROUP BY 1),
    degrees AS (SELECT a AS copy_of, count(*) AS n FROM links GROUP BY 1)
    SELECT w.doc_id, c.class_id, c.copy_of, coalesce(d.n, 0) AS n_links
    FROM w JOIN reps ON array_to_string(w.words, ' ') = reps.body JOIN classes c USING (copy_of) LEFT JOIN degrees d USING (copy_of)"""


def _op10() -> str:
    # the given pages keep their article in one element; its blocks are h1 and p
    return r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
    blocks AS (
        SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>|<br>'), lambda x:
            trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
                '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a)
    SELECT page_id, url, text, length(text) AS n_chars
    FROM (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM blocks)"""


def _op11() -> str:
    return """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
              AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
        WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
    reach(vec_id, other) AS (
        SELECT a, b FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
    least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
    degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
           e.vec_id <= coalesce(l.other, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN degree d USING (vec_id) LEFT JOIN least l USING (vec_id)"""


def _op13() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH pieces AS (
        SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
        FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS body FROM documents)),
    spans AS (
        SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
        FROM pieces, (VALUES (1), (2), (3)) s(k)),
    f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM spans GROUP BY ALL),
    total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    cuts AS (
        SELECT c.lang, c.k, c.phrase, c.a, i,
               array_to_string(string_split(c.phrase, ' ')[1:i], ' ') AS head, array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ') AS tail
        FROM f c, (VALUES (1), (2)) s(i) WHERE c.a >= 10 AND i < c.k),
    scored AS (
        SELECT c.*, l.a AS l, r.a AS r, 1000000 * c.a * c.a // (l.a * r.a) AS score
        FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head AND l.k = c.i
                    JOIN f r ON r.lang = c.lang AND r.phrase = c.tail AND r.k = c.k - c.i),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, i) = 1),
    longer AS (
        SELECT lang, part, max(a) AS a FROM (
            SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part
            FROM f WHERE k = 3 AND a >= 10) GROUP BY lang, part),
    kept AS (SELECT b.* FROM best b LEFT JOIN longer m ON m.lang = b.lang AND m.part = b.phrase AND b.k = 2 WHERE m.a IS NULL OR 100 * m.a < 50 * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
           a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM kept JOIN total USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": _op3(), "op10_main_text": _op10(), "op7_mixing": _op7(), "op8_line_dedup": _op8(), "op9_secret_scan": _op9()} | {
        "op11_embedding_dedup": _op11(), "op13_collocations": _op13()
    }
