"""DuckDB SQL for the queries it can express, apart from the operators' own code."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 (reflected polynomial 0xEDB88320) of an ASCII string, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch)::UBIGINT)"
    byte = "list_reduce([xor(crc, byte)] || list_transform(range(8), lambda i: 0::UBIGINT), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    return f"xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || {codes}, lambda crc, byte: {byte}))"


def _leaf(n_chars: str) -> str:
    framed = lambda c: f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(framed(c) for c in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf,
         CASE WHEN {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), nodes AS (
  SELECT 0 AS lvl, tree, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lvl, tree, pos // 2, n
), groups AS (
  SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS lvl, pos, n, h FROM groups
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 2, n
), steps AS (
  SELECT p.id, a.lvl AS k, (p.pos >> a.lvl) % 2 = 1 AS on_left, coalesce(b.h, '') AS h
  FROM placed p JOIN (SELECT DISTINCT tree, lvl FROM nodes WHERE n > 1) a USING (tree)
  LEFT JOIN nodes b ON b.tree = p.tree AND b.lvl = a.lvl AND b.pos = xor(p.pos >> a.lvl, 1)
  UNION ALL
  SELECT p.id, 1000 + a.lvl, (g.pos >> a.lvl) % 2 = 1, coalesce(b.h, '')
  FROM placed p JOIN groups g USING (tree) CROSS JOIN (SELECT DISTINCT lvl FROM upper_nodes WHERE n > 1) a
  LEFT JOIN upper_nodes b ON b.lvl = a.lvl AND b.pos = xor(g.pos >> a.lvl, 1)
), path AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS k, on_left, h FROM steps
), folded AS (
  SELECT id, 0::BIGINT AS k, other AS h FROM placed
  UNION ALL
  SELECT f.id, p.k, sha256(CASE WHEN p.on_left THEN p.h || f.h ELSE f.h || p.h END) FROM folded f JOIN path p ON p.id = f.id AND p.k = f.k + 1
), ends AS (
  SELECT id, arg_max(h, k) AS folded_root, max(k) + 1 AS depth FROM folded GROUP BY id
), proofs AS (
  SELECT id, sha256(coalesce(string_agg(h, '' ORDER BY k), '')) AS proof_sha256 FROM path GROUP BY id
)
SELECT p.doc_id, p.leaf, g.h AS subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root,
       e.folded_root = r.h AS verified, CASE WHEN {crc32('doc_id::VARCHAR')} % 7 = 0 THEN e.depth ELSE 0 END AS copied_nodes
FROM placed p JOIN groups g USING (tree) JOIN ends e USING (id) LEFT JOIN proofs q USING (id) CROSS JOIN (SELECT h FROM upper_nodes WHERE n = 1) r
"""

RUNS = f"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         {crc32('doc_id::VARCHAR')}::BIGINT AS h
  FROM documents
), planted AS (
  SELECT *, len(w) AS n, (h // 10) % nullif(len(w), 0) AS a FROM split
), period AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM planted
), words AS (
  SELECT id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM period)
), meet AS (
  SELECT x.id, y.i - x.i AS q, y.i AS j FROM words x JOIN words y ON y.id = x.id AND y.word = x.word AND y.i > x.i AND 4 * (y.i - x.i) <= y.n
), islands AS (
  SELECT id, q, min(j) - q AS start, count(*) + q AS length
  FROM (SELECT *, j - row_number() OVER (PARTITION BY id, q ORDER BY j) AS island FROM meet) GROUP BY id, q, island
), long AS (
  SELECT * FROM islands WHERE length >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM long l WHERE NOT EXISTS (
    SELECT 1 FROM long s WHERE s.id = l.id AND s.q < l.q AND s.start <= l.start AND s.start + s.length >= l.start + l.length)
), summary AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY id
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY length::DOUBLE / q DESC, start, q) = 1
), kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.id = w.id AND w.i >= r.start + r.q AND w.i < r.start + r.length) GROUP BY id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM split LEFT JOIN summary USING (id) LEFT JOIN best USING (id) LEFT JOIN kept USING (id)
"""

_FEATURES = {
    "word_length": ("1000 * word_chars // n_words", 500), "symbols": ("1000 * n_symbols // word_chars", 10),
    "capitals": ("1000 * n_capitals // word_chars", 30), "dup_lines": ("1000 * n_dup_lines // (n_lines + 20)", 30),
    "repeats": ("1000 * n_repeat_words // (n_words + 100)", 60),
    "echoes": ("1000 * n_echo_words // (n_words + 20)", 30),
}
_LONG = " UNION ALL ".join(f"SELECT id, lang_key, source_key, '{f}' AS feature, {w} AS least, {e} AS v FROM counts WHERE NOT base_failed"
                           for f, (e, w) in _FEATURES.items())


def _fences(level: str, keys: str) -> str:
    by = f"{keys}, feature" if keys else "feature"
    return f"""{level} AS (
  SELECT {by}, n, q1 - 3 * greatest(q3 - q1, least) AS low, q3 + 3 * greatest(q3 - q1, least) AS high FROM (
    SELECT {by}, max(least) AS least, max(total) AS n, min(lowest) FILTER (4 * upto >= total) AS q1, min(highest) FILTER (4 * upto >= 3 * total) AS q3
    FROM (SELECT {by}, lowest, highest, max(least) AS least, sum(count(*)) OVER (PARTITION BY {by} ORDER BY lowest) AS upto,
                 sum(count(*)) OVER (PARTITION BY {by}) AS total FROM bucketed GROUP BY {by}, lowest, highest) GROUP BY {by}))"""


QUALITY = f"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, '=' || lang AS lang_key, '=' || source AS source_key, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts
), windows AS (
  SELECT id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM split)
), again AS (
  SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, win) > 1
), covered AS (
  SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(i, i + 8)) AS place FROM again) GROUP BY id
), counts AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (
    SELECT s.id, doc_id, coalesce(lang_key, '') AS lang_key, coalesce(source_key, '') AS source_key, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo_words
    FROM split s LEFT JOIN covered USING (id))
), long AS ({_LONG}
), bucketed AS (
  SELECT *, (v >> shift) << shift AS lowest, (((v >> shift) + 1) << shift) - 1 AS highest FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS shift FROM long)
), {_fences('own', 'lang_key, source_key')}, {_fences('language', 'lang_key')}, {_fences('corpus', '')}
, judged AS (
  SELECT l.id, list(l.feature ORDER BY l.feature) FILTER (NOT l.v BETWEEN
           CASE WHEN o.n >= 200 THEN o.low WHEN g.n >= 200 THEN g.low ELSE c.low END AND
           CASE WHEN o.n >= 200 THEN o.high WHEN g.n >= 200 THEN g.high ELSE c.high END) AS bad
  FROM long l JOIN own o USING (lang_key, source_key, feature) JOIN language g USING (lang_key, feature) JOIN corpus c USING (feature) GROUP BY l.id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad IS NULL AS kept,
       coalesce(array_to_string(bad, ','), '') AS outliers
FROM counts LEFT JOIN judged USING (id)
"""
