"""DuckDB statements of the search, repair and mixing queries."""
from __future__ import annotations

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SEARCH = f"""
WITH tok AS (
  SELECT 0 AS item, id, key, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS id, doc_id AS key, text FROM documents)
  UNION ALL
  SELECT 1, id, key, unnest({_TERMS}) FROM (SELECT row_number() OVER () AS id, item_id AS key, text FROM benchmark)),
t AS (SELECT id, key, term, count(*) AS tf FROM tok WHERE item = 0 GROUP BY ALL),
d AS (SELECT id, sum(tf)::BIGINT AS n FROM t GROUP BY id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM t, s GROUP BY term),
q AS (SELECT id, key, term, count(*) AS times FROM tok WHERE item = 1 GROUP BY ALL),
c AS (SELECT q.id AS q, q.key AS item_id, t.id, t.key AS doc_id, sum(times * w *
        ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN d ON d.id = t.id, s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

REPAIR = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM raw, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
numbered AS (SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
faults AS (SELECT *, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
marked AS (SELECT *, lag(ini) OVER (PARTITION BY conv ORDER BY i) || ini AS pair FROM faults),
-- states: 0 nothing, 1 system, 2 user, 3 assistant
ins(p, q, letters) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (1, 2, 'I'), (2, 3, 'I'),
  (3, 2, 'I'), (0, 3, 'II'), (1, 3, 'II')),
edit(ini, p, q, letter, cost) AS (VALUES ('s', 0, 1, 'K', 0), ('u', 0, 2, 'K', 0), ('u', 1, 2, 'K', 0), ('u', 3, 2, 'K', 0),
  ('a', 2, 3, 'K', 0), ('*', 0, 2, 'R', 3), ('*', 1, 2, 'R', 3), ('*', 2, 3, 'R', 3), ('*', 3, 2, 'R', 3),
  ('*', 0, 0, 'D', 4), ('*', 1, 1, 'D', 4), ('*', 2, 2, 'D', 4), ('*', 3, 3, 'D', 4)),
ways AS (SELECT m.conv, m.i, ins.p, edit.q, 3 * length(letters) + cost
      + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, letters || letter AS letters
    FROM marked m, ins JOIN edit ON edit.p = ins.q
    WHERE edit.ini IN ('*', m.ini) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))),
best AS (
  SELECT DISTINCT conv, 0::BIGINT AS i, 0 AS state, {'c': 0::BIGINT, 'a': ''} AS v FROM marked
  UNION ALL
  SELECT b.conv, b.i + 1, w.q, min({'c': (b.v.c + w.cost)::BIGINT, 'a': b.v.a || w.letters})
  FROM best b JOIN ways w ON w.conv = b.conv AND w.i = b.i + 1 AND w.p = b.state GROUP BY b.conv, b.i, w.q),
done AS (SELECT conv, min({'c': v.c + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END,
      'a': v.a || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS v
    FROM best JOIN (SELECT conv, max(i) AS i FROM marked GROUP BY conv) USING (conv, i) GROUP BY conv),
letters AS (SELECT conv, unnest(string_split(v.a, '')) AS letter, unnest(range(1, length(v.a) + 1)) AS spot FROM done),
placed AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv ORDER BY spot) AS i FROM letters),
shown AS (SELECT p.conv, spot, letter, role, text, ini, row_number() OVER (PARTITION BY p.conv ORDER BY spot) AS pos,
    first_value(letter || ini) OVER (PARTITION BY p.conv ORDER BY spot) = 'Ks' AS led
  FROM placed p JOIN marked m ON m.conv = p.conv AND m.i = greatest(p.i, 1) WHERE letter <> 'D'),
said AS (SELECT conv, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE
      CASE WHEN (pos - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
      CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos)) AS digest FROM shown GROUP BY conv),
sums AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost,
  coalesce(v.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv FROM conversations) c
  LEFT JOIN sums USING (conv) LEFT JOIN done USING (conv) LEFT JOIN said USING (conv)"""

MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'),
             lambda w: w <> '')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT (any_value(x.total) * 1.5::DOUBLE - coalesce(sum(b.most) FILTER (WHERE b.most / b.weight < a.most / a.weight), 0))
      / sum(b.weight) FILTER (WHERE b.most / b.weight >= a.most / a.weight) AS level
      FROM w a, w b, (SELECT sum(source_size)::BIGINT AS total FROM s) x GROUP BY a.source),
g AS (SELECT w.*, least(most, weight * (SELECT max(level) FROM o)) AS target FROM w),
l AS (SELECT d.*, g.source_size, g.target, round(g.target)::BIGINT AS cut, coalesce(sum(size) OVER (
        PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, cut) - start)
  + greatest(0, least(start + source_size + size, cut) - start - source_size))::BIGINT AS taken FROM l"""
