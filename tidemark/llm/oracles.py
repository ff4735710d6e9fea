"""SQL counterparts (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import mixing

ORACLES: dict[str, str] = {}

ORACLES["op3_near_text"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.seen = both_ways.a
), found AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN found ON node = doc_id LEFT JOIN sizes USING (doc_id)
"""

ORACLES["op4_near_vectors"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), found AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN found ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

ORACLES["op8_decontaminate"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: w[i:i + 9])) AS win
  FROM items WHERE len(w) > 0
), lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, lengths WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, n, item_id FROM places JOIN windows ON places.w[i:i + n - 1] = win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLES["op10_warc"] = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS code FROM pages
), tops AS (SELECT code, max(page_id) AS top FROM rows GROUP BY code),
digits AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, top,
         list_transform(range(0, 8), lambda k: ('0x' || substr(code, 5 * k + 1, 5))::INTEGER) AS five
  FROM rows JOIN tops USING (code)
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to, true AS intact
FROM digits
"""

ORACLES["op7_url_filter"] = r"""
WITH caps AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INTEGER AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), hosts AS (
  SELECT host, ('0x' || substr(md5(host), 1, 6))::INTEGER AS code FROM (SELECT DISTINCT host FROM caps WHERE host <> '')
), entries AS (
  SELECT 'd:' || host AS pattern, 'block' AS verdict, d AS day, added FROM hosts,
    (VALUES (0, true), (60, false), (120, true)) e(after, added), LATERAL (SELECT DATE '2024-01-01' + (code % 180 + after)::INTEGER AS d)
  WHERE code % 3 = 0
  UNION ALL
  SELECT 'd:' || array_to_string(string_split(host, '.')[-3:], '.'), 'block', DATE '2024-01-01' + (code % 180 + 30)::INTEGER, true
  FROM hosts WHERE code % 5 = 0
  UNION ALL
  SELECT 'p:' || host || '/en/', 'allow', DATE '2024-01-01' + (code % 180 + after)::INTEGER, added FROM hosts,
    (VALUES (10, true), (200, false)) e(after, added) WHERE code % 4 = 1
), daily AS (SELECT pattern, verdict, day, bool_and(added) AS added FROM entries GROUP BY pattern, verdict, day),
spans AS (
  SELECT *, coalesce(lead(day) OVER (PARTITION BY pattern, verdict ORDER BY day), DATE '9999-12-31') AS until FROM daily
), met AS (
  SELECT page_id, s.*, starts_with(pattern, 'p:') AS folder, length(pattern) AS size FROM caps JOIN spans s
  ON s.added AND fetched >= s.day AND fetched < s.until AND (
    (starts_with(pattern, 'd:') AND (host = substr(pattern, 3) OR ends_with(host, '.' || substr(pattern, 3))))
    OR (starts_with(pattern, 'p:') AND starts_with(host || path, substr(pattern, 3))))
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY folder DESC, size DESC, verdict = 'allow' DESC) AS r FROM met
)
SELECT caps.page_id, url, fetched::VARCHAR AS fetched, coalesce(verdict, 'none') AS verdict, pattern, day::VARCHAR AS valid_from
FROM caps LEFT JOIN best ON caps.page_id = best.page_id AND r = 1
"""


# crc32 in SQL: a table of 256 remainders, then one step per byte.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda s, z: xor(s >> 1, (s & 1) * 3988292384))) AS tab"""


def _crc32(text: str) -> str:
    code = f"encode({text})"
    steps = (f"list_concat([4294967295], list_transform(range(octet_length({code})), "
             f"lambda i: ('0x' || substr(hex({code}), 2 * i + 1, 2))::BIGINT))")
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


ORACLES["op12_spelling"] = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32("id || ':' || run")} AS h FROM counted, crc
), spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run)) + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM holes
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM cut JOIN (SELECT word AS rest FROM words) USING (rest)
  UNION SELECT rest, word FROM cut JOIN (SELECT word AS rest FROM words) USING (rest)
), ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r
  FROM pairs JOIN words ON b = word
), linked AS MATERIALIZED (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 2 * w.n THEN b END AS form, CASE WHEN x.n >= 2 * w.n THEN x.n END AS form_n
  FROM words w LEFT JOIN ranked x ON a = word AND r = 1
), chain AS (
  SELECT word, word AS root, form AS next FROM linked
  UNION ALL
  SELECT chain.word, l.word, l.form FROM chain JOIN linked l ON l.word = chain.next
)
SELECT linked.word, n, n_near, form, form_n, root FROM linked JOIN chain ON chain.word = linked.word AND next IS NULL
"""

ORACLES["op11_prefix_trie"] = f"""
WITH crc AS ({CRC_TABLE}),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, {_crc32("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc
), lists AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT ids.conv_id, list_concat(coalesce(heads.turns, [])[1:h], own.turns[h + 1:]) AS turns
  FROM ids JOIN lists own ON own.conv_id = ids.conv_id LEFT JOIN lists heads ON heads.conv_id = head
), paths AS (
  SELECT conv_id, len(turns) AS size, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), keyed AS MATERIALIZED (
  SELECT conv_id, size, depth, sha256(turns[1:depth]::VARCHAR) AS node,
         CASE WHEN depth > 0 THEN sha256(turns[1:depth - 1]::VARCHAR) END AS parent,
         CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars
  FROM paths
), nodes AS MATERIALIZED (
  SELECT depth, node, parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         list(conv_id ORDER BY conv_id) FILTER (size = depth) AS ends
  FROM keyed GROUP BY ALL
), kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
under AS (
  SELECT DISTINCT a.depth, a.node, b.depth AS low_depth, b.node AS low FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), sums AS (
  SELECT under.depth, under.node, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved_tokens
  FROM under JOIN nodes x ON x.depth = low_depth AND x.node = low LEFT JOIN kids ON kids.node = low GROUP BY ALL
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(array_to_string(n.ends, ','), '')) AS ends_sha256
FROM nodes n JOIN sums USING (depth, node) LEFT JOIN kids ON kids.node = n.node
LEFT JOIN nodes up ON up.node = n.parent AND up.depth = n.depth - 1
"""


def _mixing() -> str:
    """Bounded raking, one recursion step per dimension and round; feasible goals first."""
    def named(d: str) -> str:
        return ", ".join(f"'{v}'" for v in mixing.TARGETS[d] if v != mixing.OTHER)

    def wanted(d: str) -> str:
        return "CASE " + d + " " + " ".join(f"WHEN '{v}' THEN {t!r}::DOUBLE" for v, t in mixing.TARGETS[d].items()) + " ELSE 0 END"

    goals = " UNION ALL ".join(
        f"SELECT {k} AS dim, {d} AS value, {wanted(d)} AS want, sum(tokens)::DOUBLE AS room FROM counted GROUP BY {d}"
        for k, d in enumerate(mixing.DIMENSIONS))
    value = "CASE dim WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END"
    return rf"""
WITH RECURSIVE cells AS (
  SELECT doc_id, CASE WHEN source IN ({named("source")}) THEN source ELSE 'other' END AS source,
    CASE WHEN lang IN ({named("lang")}) THEN lang ELSE 'other' END AS lang,
    CASE WHEN coalesce(text, '') = '' THEN 'other' WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shout'
         WHEN contains(text, 'Licensed under') THEN 'licence' ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents
), counted AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM cells GROUP BY ALL HAVING sum(tokens) > 0),
total AS MATERIALIZED (SELECT sum(tokens) * {mixing.SHARE} AS all_wanted FROM counted),
rooms AS MATERIALIZED ({goals}),
fits AS (
  SELECT 0 AS step, dim, value, want, room, false AS filled, all_wanted * want / sum(want) OVER (PARTITION BY dim) AS goal FROM rooms, total
  UNION ALL
  SELECT step + 1, dim, value, want, room, now, CASE WHEN now THEN room ELSE
    (all_wanted - sum(CASE WHEN now THEN room ELSE 0 END) OVER d) * want / sum(CASE WHEN now THEN 0 ELSE want END) OVER d END
  FROM (SELECT *, filled OR goal > room AS now FROM fits), total WHERE step < 25 WINDOW d AS (PARTITION BY dim)
), goals AS MATERIALIZED (SELECT dim, value, goal FROM fits WHERE step = 25),
aims AS MATERIALIZED (
  SELECT source, lang, topic, tokens::DOUBLE AS tokens, s.goal AS by_source, l.goal AS by_lang, t.goal AS by_topic FROM counted
  JOIN goals s ON s.dim = 0 AND s.value = source JOIN goals l ON l.dim = 1 AND l.value = lang JOIN goals t ON t.dim = 2 AND t.value = topic
), raked AS (
  SELECT 0 AS step, 0 AS dim, source, lang, topic, tokens, tokens * {mixing.SHARE} AS asked FROM aims
  UNION ALL
  SELECT step + 1, (dim + 1) % 3, source, lang, topic, tokens, asked * CASE WHEN held > goal THEN goal / (held + free)
    WHEN free > 0 THEN (goal - held) / free ELSE 1 END
  FROM (
    SELECT r.*, CASE dim WHEN 0 THEN by_source WHEN 1 THEN by_lang ELSE by_topic END AS goal,
      sum(CASE WHEN asked >= r.tokens THEN r.tokens ELSE 0 END) OVER v AS held, sum(CASE WHEN asked >= r.tokens THEN 0 ELSE asked END) OVER v AS free
    FROM raked r JOIN aims USING (source, lang, topic) WINDOW v AS (PARTITION BY {value})
  ) WHERE step < {3 * mixing.ROUNDS}
), plan AS (
  SELECT source, lang, topic, least(asked, tokens) / sum(least(asked, tokens)) OVER () AS w, least(asked, tokens) / tokens AS p
  FROM raked WHERE step = {3 * mixing.ROUNDS}
)
SELECT doc_id, source, lang, topic, tokens, round(coalesce(w, 0), 6) AS cell_weight, round(coalesce(p, 0), 6) AS prob,
       ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < coalesce(p, 0) AS sampled
FROM cells LEFT JOIN plan USING (source, lang, topic)
"""


ORACLES["op5_mixing"] = _mixing()
