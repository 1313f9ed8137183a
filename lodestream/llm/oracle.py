"""The results of the operators that SQL can express, for DuckDB. None of it reads anything that an operator wrote."""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING_DEDUP = f"""
WITH doc AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM doc WHERE len(w) >= 20),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS passage FROM win),
later AS (SELECT doc_id, i FROM keyed QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM doc),
cut AS (SELECT word.doc_id, word.i, word.word, max(CASE WHEN later.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN later ON word.doc_id = later.doc_id AND word.i = later.i),
done AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS left_over FROM cut GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM doc LEFT JOIN done USING (doc_id)"""

SUFFIX_DEDUP = """
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
start AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM doc WHERE octet_length(b) >= 200),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, sha256(array_slice(b, i, i + 199)) AS h FROM start) QUALIFY count(*) OVER (PARTITION BY h) > 1),
ends AS (SELECT doc_id, i, i + 200 AS stop, lag(i + 200) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again),
run AS (SELECT *, sum(CASE WHEN before >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM ends),
span AS (SELECT doc_id, k, min(i) AS a, max(stop) AS z FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM span),
done AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n, max(z) AS tail, coalesce(string_agg(hex(CASE WHEN a > from_ THEN array_slice(b, from_, a - 1) ELSE ''::BLOB END), '' ORDER BY a), '') AS head FROM gap JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(CASE WHEN tail IS NULL THEN b ELSE unhex(head || hex(CASE WHEN tail > octet_length(b) THEN ''::BLOB ELSE array_slice(b, tail, octet_length(b)) END)) END) AS kept_sha256
FROM doc LEFT JOIN done USING (doc_id)"""

JACCARD_JOIN = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM doc UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT doc.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM doc JOIN reach ON reach.x = doc.doc_id LEFT JOIN size ON size.doc_id = doc.doc_id GROUP BY doc.doc_id"""

_count = lambda chars: f"len(regexp_extract_all(line, '{chars}'))"
#: The phrases are those of `stats.BOILERPLATE`, which the rules define.
_PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "enable javascript", "lorem ipsum", "click here",
    "subscribe to", "skip to content", "back to top", "powered by", "share on", "© 20", "copyright 20",
)

QUALITY_RULES = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
five AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM five QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, line, i, {WORDS.format(text="line")} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM doc)),
told AS (SELECT doc_id, len(lw) AS n, lw[-1] AS last, translate(line, '{UPPER}', '{LOWER}') AS low, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
  {_count("[|>]")} AS bars, {_count("[#*$%&|<>]")} AS symbols, {_count("[.!?]")} AS stops, {_count("!")} AS shouts, {_count("[A-Z]")} AS upper, {_count("[A-Za-z" + chr(0xC0) + "-" + chr(0x10FFFF) + "]")} AS letters FROM line WHERE len(lw) > 0),
judged AS (SELECT doc_id, n, again, again
  OR {" OR ".join(f"contains(low, '{p}')" for p in _PHRASES)}
  OR n < 4 AND stops = 0 AND NOT regexp_matches(last, '[.!?:;"'')\\]}}»”…]$')
  OR n >= 4 AND (10 * upper > 7 * letters AND letters > 0 OR 2 * shouts > n)
  OR 5 * symbols > n OR bars >= 3 AND 5 * bars > n AS bad FROM told),
lines AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_lines_removed, sum(n) FILTER (WHERE bad) AS n_words_removed FROM judged GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed FROM doc LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * (n_words - n_words_removed) >= n_words AS kept,
CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(n_words_removed AS BIGINT) AS n_words_removed FROM base"""

FILTER_AUDIT = f"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
label AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic, MAP {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
  'E': coalesce(doc.doc_id > min(doc.doc_id) OVER (PARTITION BY text), false)}} AS f FROM doc LEFT JOIN label ON label.doc_id = doc.doc_id),
each AS (SELECT part, good, toxic, [x for x in ['A', 'B', 'C', 'D', 'E'] if f[x]] AS fails, count(*) AS n FROM failed GROUP BY ALL),
perm AS (SELECT '' AS o UNION ALL SELECT o || x FROM perm, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE NOT contains(o, x)),
step AS (SELECT o AS filter_order, s AS step, o[s] AS x, string_split(o[:s - 1], '') AS before FROM perm, range(1, 6) r(s) WHERE length(o) = 5),
told AS (SELECT part, filter_order, step, x, sum(CASE WHEN NOT list_contains(fails, x) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN list_contains(fails, x) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS removed, sum(CASE WHEN list_contains(fails, x) AND list_has_any(fails, before) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = [x] THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN good AND list_contains(fails, x) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS good_lost,
  sum(CASE WHEN toxic AND list_contains(fails, x) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS toxic_lost FROM each, step GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM told"""

#: CRC-32 of hexadecimal bytes `h`, by the table of the reflected polynomial.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))"
_CRC = "xor(list_reduce([CAST('0x' || b AS BIGINT) for b in regexp_extract_all({h}, '..')], lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
_HASHED = "CAST('0x' || substr(md5({parts}), 1, 13) AS BIGINT)"


def _shards(levels: int) -> str:
    """A k-d tree of so many levels, each halving the bytes of every node along its widest dimension."""
    dims = [f"coalesce({_HASHED.format(parts=c)}::DOUBLE, -1)" for c in ("source", "lang")] + ["coalesce(CASE WHEN n_chars >= 0 THEN log2(1 + n_chars) ELSE n_chars END, -1)", "coalesce(doc_id::DOUBLE, -1)"]
    sql = f"""WITH tab AS MATERIALIZED ({_CRC_TABLE}),
doc AS (SELECT *, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, lang, source, n_chars, size, {_CRC.format(h="h")} AS crc FROM doc, tab),
copied AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, crc, source, lang, n_chars) - 1 AS copy FROM crc),
n0 AS (SELECT doc_id, size, crc, [{", ".join(dims)}] AS c, {_HASHED.format(parts="concat_ws('|', doc_id, size, crc, source, lang, n_chars, doc_id, copy)")} AS tie, 1 AS node FROM copied),
width AS (SELECT [{", ".join(f"max(c[{i}]) - min(c[{i}])" for i in range(1, 5))}] AS w FROM n0)"""
    for k in range(levels):
        ratios = ", ".join(f"CASE WHEN any_value(w)[{i}] > 0 THEN (max(c[{i}]) - min(c[{i}])) / any_value(w)[{i}] ELSE 0 END" for i in range(1, 5))
        sql += f""",
d{k} AS (SELECT node, r.dim, r.total FROM (SELECT node, sum(size) AS total, [{ratios}] AS e FROM n{k}, width GROUP BY node), LATERAL (SELECT list_position(e, list_max(e)) AS dim, total) r),
b{k} AS (SELECT n{k}.*, total, sum(size) OVER (PARTITION BY node ORDER BY c[dim], tie) - size AS before FROM n{k} JOIN d{k} USING (node)),
n{k + 1} AS (SELECT doc_id, size, crc, c, tie, 2 * node + CASE WHEN 2 * (total // 2 - before) >= size THEN 0 ELSE 1 END AS node FROM b{k})"""
    return f"""{sql}
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(node - {2**levels} AS INTEGER) AS shard, row_number() OVER (PARTITION BY node ORDER BY tie, doc_id, crc, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n{levels}"""


PREFIX_TRIE = f"""
WITH tab AS MATERIALIZED ({_CRC_TABLE}),
turn AS (SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, list(t ORDER BY pos) AS ts, hex(encode(CAST(c AS VARCHAR))) AS h FROM turn GROUP BY c),
told AS (SELECT conv.c, conv.ts, {_CRC.format(h="conv.h")} % 9 AS h, coalesce(donor.ts, []) AS theirs FROM conv CROSS JOIN tab LEFT JOIN conv AS donor ON donor.c = conv.c - conv.c % 5),
again AS (SELECT c, list_concat(theirs[1:h], ts[h + 1:]) AS ts FROM told),
prefix AS (SELECT c, d, ts[1:d] AS p, d = len(ts) AS ends, octet_length(encode(CASE WHEN d > 0 THEN ts[d].text ELSE '' END)) AS bytes FROM again, LATERAL unnest(range(0, len(ts) + 1)) r(d)),
node AS (SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) * (count(*) - 1) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefix GROUP BY p),
child AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
below AS (SELECT p[1:d] AS p, sum(own) AS saved_tokens, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves FROM node LEFT JOIN child USING (p), LATERAL unnest(range(0, depth + 1)) r(d) GROUP BY 1)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN below USING (p) LEFT JOIN child USING (p) LEFT JOIN node AS up ON up.p = node.p[1:node.depth - 1] AND node.depth > 0"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op2_suffix_dedup": SUFFIX_DEDUP,
    "op3_jaccard_join": JACCARD_JOIN,
    "op7_quality_rules": QUALITY_RULES,
    "op11_kd_shards": _shards(4),
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_filter_audit": FILTER_AUDIT,
}
