"""SQL that gives the same rows as the queries of this subpackage, where SQL can."""

#: The inner list_reduce is one byte of a bitwise CRC-32; a path is the list of a node's turn hashes.
TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS family, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, n: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS inverted
  FROM t
), h AS (SELECT conv_id, family, xor(inverted, 4294967295) % 9 AS h FROM c),
whole AS (
  SELECT h.conv_id, 0 AS part, t.pos, t.role, t.txt FROM h JOIN t ON t.conv_id = h.family AND t.pos <= h.h
  UNION ALL SELECT h.conv_id, 1, t.pos, t.role, t.txt FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h
), turns AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(txt) AS bytes, list(sha256(strlen(role) || ':' || role || txt)) OVER w AS path
  FROM whole WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), members AS (
  SELECT conv_id, depth, bytes, path FROM turns UNION ALL SELECT conv_id, 0, 0, [] FROM h
), top AS (SELECT conv_id, max(depth) AS len FROM members GROUP BY conv_id),
nodes AS (
  SELECT m.depth, m.path, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(m.bytes) AS bytes,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE t.len = m.depth), '')) AS ends_sha256
  FROM members m JOIN top t USING (conv_id) GROUP BY m.depth, m.path
), kids AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT a.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) b JOIN nodes a ON a.path = b.path[:b.up] LEFT JOIN kids k ON k.path = b.path GROUP BY a.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
"""

_TERMS = r"""unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, "text" FROM documents),
tf AS (SELECT place, doc_id, term, count(*) AS tf FROM (SELECT place, doc_id, {_TERMS} FROM d) GROUP BY ALL),
sizes AS (SELECT place, sum(tf)::BIGINT AS n FROM tf GROUP BY place),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} FROM benchmark)),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
),
scores AS (
  SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (place), whole GROUP BY item_id, place, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, place))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
