"""SQL that must give the same rows as the queries it is named after."""

from __future__ import annotations


def _words(pattern: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    return f"regexp_extract_all({lowered}, '{pattern}')"


OP10 = f"""
WITH docs AS (
  SELECT doc_id, {_words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS k, w FROM (
    SELECT item_id, {_words("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")} AS w FROM benchmark
  ) AS b WHERE item_id IS NOT NULL AND len(w) > 0
), wanted AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM items
  ) AS i
), lengths AS (
  SELECT DISTINCT k FROM items
), given AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
    SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i
    FROM docs JOIN lengths ON len(w) >= k
  ) AS d
), hits AS (
  SELECT g.doc_id, g.i, g.k, q.item FROM given AS g JOIN wanted AS q ON g.k = q.k AND g.win = q.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits
  ) AS p GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) AS i GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit,
       coalesce(i.n, 0) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM docs AS d LEFT JOIN hit_words AS h ON d.doc_id = h.doc_id
LEFT JOIN hit_items AS i ON d.doc_id = i.doc_id"""

OP3 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_words("[^\\x20\\x09-\\x0D]+")} AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i
    FROM docs WHERE len(w) > 0
  ) AS d
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets AS a JOIN sets AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes AS x ON a = x.doc_id JOIN sizes AS y ON b = y.doc_id
  WHERE 100 * c >= 75 * (x.n + y.n - c)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.b) AS component_id
FROM docs AS d LEFT JOIN sizes AS s ON d.doc_id = s.doc_id JOIN reached AS r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n"""

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
_P = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {v})"

OP11 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         {_TERMS} AS w
  FROM documents
), places AS (
  SELECT d, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), cells AS (
  SELECT lang, source, term, count(*) AS n
  FROM places SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) AS g LEFT JOIN cells USING (lang, source)
  GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         {_P.format(n="coalesce(c.n, 0)", total="g.total", v="l.v")} AS p,
         {_P.format(n="k.n", total="l.total", v="l.v")} AS q
  FROM groups AS g JOIN langs AS l ON g.lang = l.lang JOIN kept AS k ON g.lang = k.lang
  LEFT JOIN cells AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, 'pair' AS part,
         coalesce(sum(abs(one.p - other.p)), 0) AS value
  FROM groups AS g JOIN groups AS h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN shares AS one ON one.lang = g.lang AND one.source = g.source
  LEFT JOIN shares AS other
    ON other.lang = h.lang AND other.source = h.source AND other.term = one.term
  GROUP BY g.lang, g.source, h.source
), found AS (
  SELECT lang, source, part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR r <= 50"""

# DuckDB has no crc32: the remainders by 4 come from the polynomial, bit by bit over the digits.
OP12 = r"""
WITH RECURSIVE given AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(concat(CAST(strlen(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''),
                         coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM given
), crc AS (
  SELECT c, s, 0 AS step, 4294967295::BIGINT AS r FROM ids
  UNION ALL
  SELECT c, s, step + 1,
         CASE WHEN step % 9 = 0 THEN xor(r, ascii(substr(s, step // 9 + 1, 1))::BIGINT)
              WHEN (r & 1) = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END
  FROM crc WHERE step < 9 * length(s)
), heads AS (
  SELECT c, xor(r, 4294967295::BIGINT) % 4 AS h FROM crc WHERE step = 9 * length(s)
), made AS (
  SELECT h.c, g.place, g.role, g.text FROM heads AS h JOIN given AS g
    ON g.c = h.c - h.c % 20 AND g.place <= h.h
  UNION ALL
  SELECT h.c, g.place + 1000000 AS place, g.role, g.text FROM heads AS h JOIN given AS g
    ON g.c = h.c AND g.place > h.h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY place) AS place, role, text FROM made
), whole AS (
  SELECT i.c, coalesce(list(struct_pack(role, text) ORDER BY place)
                       FILTER (WHERE place IS NOT NULL), []) AS turns
  FROM ids AS i LEFT JOIN placed AS p ON i.c = p.c GROUP BY i.c
), members AS (
  SELECT c, d, turns[1:d] AS node, len(turns) AS size
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole) AS w
), nodes AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n,
         CASE WHEN d = 0 THEN 0
              ELSE len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) END AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = d), ''))
           AS ends
  FROM members GROUP BY node, d
), children AS (
  SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), shaped AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, (n.n - 1) * n.words AS gain
  FROM nodes AS n LEFT JOIN children AS c ON n.node = c.node
), below AS (
  SELECT top, sum(gain) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT s.gain, s.n_children, s.node[1:k] AS top
        FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM shaped) AS s) AS t
  GROUP BY top
)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id,
       CAST(s.n AS BIGINT) AS n_convs, CAST(s.n_children AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
       s.ends AS ends_sha256
FROM shaped AS s JOIN below AS b ON b.top = s.node
LEFT JOIN shaped AS p ON s.d > 0 AND p.node = s.node[1:s.d - 1] AND p.d = s.d - 1"""

SQL = {
    "op3_jaccard_join": OP3,
    "op10_decontaminate": OP10,
    "op11_divergence": OP11,
    "op12_prefix_trie": OP12,
}
