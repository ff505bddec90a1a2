"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

MIX = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {WORDS} AS size,
         greatest(0.05::DOUBLE, coalesce(length(translate(coalesce(text, ''), '#*$%&|<>!0123456789', ''))
                  / nullif(length(coalesce(text, '')), 0)::DOUBLE, 0.05::DOUBLE)) AS q,
         (('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, (place - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, ((SELECT sum(source_size) FROM w)::BIGINT
                 - coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
                / sum(w) OVER (ORDER BY cap / w::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE,
        (SELECT arg_min(level, cap / w::DOUBLE) FROM f WHERE level * w <= cap) * w) AS target FROM f),
p AS (SELECT t.*, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""

# each passage that a turn quotes is a whole earlier turn, so its original is the first turn of the
# conversation that has its words as its text or as a line of it
NORMAL = r"trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))"
QUOTES = f"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 4 AS rule,
         {NORMAL.format("coalesce(text, '')")} AS norm FROM conversations),
units AS (SELECT conv_id, turn, norm FROM m UNION
          SELECT conv_id, turn, {NORMAL.format("line")} FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m)),
firsts AS (SELECT conv_id, norm, min(turn) AS first FROM units WHERE norm <> '' GROUP BY ALL),
q AS (SELECT m.conv_id, m.turn, m.rule, one.norm AS n1, two.norm AS n2 FROM m
      LEFT JOIN m AS one ON one.conv_id = m.conv_id AND one.turn = m.turn - 1
      LEFT JOIN m AS two ON two.conv_id = m.conv_id AND two.turn = m.turn - 2),
p AS (SELECT conv_id, turn, CASE WHEN rule IN (1, 2) THEN n1 WHEN rule = 3 THEN n2 END AS direct,
             CASE WHEN rule = 2 THEN n2 END AS nested FROM q),
l AS (SELECT p.conv_id, p.turn, f.first AS parent,
             coalesce((direct <> '')::INT, 0) + coalesce((nested <> '')::INT, 0) AS n_quotes
      FROM p LEFT JOIN firsts AS f ON f.conv_id = p.conv_id AND f.norm = p.direct),
t AS (SELECT conv_id, turn, parent, n_quotes, [turn] AS path FROM l WHERE parent IS NULL UNION ALL
      SELECT l.conv_id, l.turn, l.parent, l.n_quotes, list_append(t.path, l.turn) FROM l JOIN t ON l.conv_id = t.conv_id AND l.parent = t.turn)
SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY path) - 1 AS position, t.turn, role,
       trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text,
       parent AS parent_turn, len(path) - 1 AS depth, n_quotes, n_quotes AS n_linked
FROM t JOIN m ON m.conv_id = t.conv_id AND m.turn = t.turn
"""


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {TERMS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, width, array_to_string(w[i:i + width - 1], ' ') AS gram
            FROM (SELECT item, w, least(10, len(w)) AS width, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, width, array_to_string(w[i:i + width - 1], ' ') AS gram
          FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)),
found AS (SELECT r, i, g.width, item FROM grams AS g JOIN windows AS b ON b.width = g.width AND b.gram = g.gram),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS p FROM found) GROUP BY r),
held AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""

# crc32 bit by bit over the digits of a number
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(d) AS BIGINT) FOR d IN string_split(CAST({0} AS VARCHAR), '')]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
TRIE = f"""
WITH own AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS x, {WORDS} AS words
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, x, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS place FROM own),
c AS (SELECT conv_id, {CRC.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (SELECT c.conv_id, 1 AS part, place, x, words FROM c JOIN placed AS p ON p.conv_id = c.conv_id - c.conv_id % 20 AND place <= h
            UNION ALL SELECT c.conv_id, 2, place, x, words FROM c JOIN placed AS p ON p.conv_id = c.conv_id AND place > h),
prefixes AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(x, '') OVER w AS key, words FROM rebuilt
             WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)),
members AS (SELECT conv_id, depth, key, words FROM prefixes UNION ALL SELECT conv_id, 0, '', 0 FROM c),
last AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM members GROUP BY key, depth),
up AS (SELECT n.key, m.key AS parent FROM nodes AS n JOIN members AS m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1),
n_children AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent),
below AS (SELECT m.key, sum((n_convs - 1) * n.words)::BIGINT AS saved_tokens, count(*) FILTER (k.key IS NULL) AS n_leaves
          FROM nodes AS n JOIN members AS m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN n_children AS k ON k.key = n.key GROUP BY m.key),
ends AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM members JOIN last USING (conv_id, depth) GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes AS n LEFT JOIN up ON up.key = n.key LEFT JOIN nodes AS p ON p.key = up.parent LEFT JOIN n_children AS k ON k.key = n.key
JOIN below AS b ON b.key = n.key LEFT JOIN ends AS e ON e.key = n.key
"""

MIDDLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
k AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS two,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, least(one, two)) AS prefix, substr(text, least(one, two) + 1, abs(one - two)) AS middle,
             substr(text, greatest(one, two) + 1) AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


ORACLES: dict[str, str] = {"op1_quotes": QUOTES, "op7_mixing": MIX, "op8_bloom_dedup": DEDUP,
                            "op11_positional_index": DECONTAMINATE, "op12_prefix_trie": TRIE,
                            "op13_fill_in_middle": MIDDLE}
