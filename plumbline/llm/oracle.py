"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from .queries import SHARD_BYTES

WORD = r"[^\x20\x09-\x0D]+"

#: Sources in order of the level at which they stop: the first that the level of the rest doesn't reach settles it.
OP4 = rf"""
WITH sized AS (
  SELECT doc_id, text, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS key,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS symbols
  FROM documents),
drawn AS (
  SELECT *, -ln((('0x' || md5(concat_ws(chr(31), '17', coalesce(doc_id::VARCHAR, chr(0)), coalesce(text, chr(0))))[1:13])::BIGINT::DOUBLE + 0.5)
                / 4503599627370496.0) / greatest(0.25, 2.0 - 4.0 * symbols / greatest(size, 1)) AS draw
  FROM sized),
sources AS (
  SELECT key, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY key),
ranked AS (
  SELECT *, 2.0 * source_size / weight AS breaks,
         coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         1.5 * sum(source_size) OVER () AS total
  FROM sources),
level AS (SELECT (total - capped) / rest AS level FROM ranked WHERE breaks >= (total - capped) / rest ORDER BY breaks, key LIMIT 1),
targets AS (
  SELECT key, source_size, least(2.0 * source_size, level * weight) AS target,
         CASE WHEN source_size > 0 THEN floor(least(2.0 * source_size, level * weight) / source_size) ELSE 0 END::BIGINT AS epochs
  FROM ranked, level),
tied AS (
  SELECT key, draw, sum(size)::BIGINT AS s, sum(sum(size)) OVER (PARTITION BY key ORDER BY draw) AS upto FROM drawn GROUP BY key, draw),
cuts AS (
  SELECT t.key, max(draw) AS last_draw
  FROM tied t JOIN targets USING (key)
  WHERE upto <= target - epochs * source_size
     OR (upto - s < target - epochs * source_size AND abs(upto - (target - epochs * source_size)) <= abs(upto - s - (target - epochs * source_size)))
  GROUP BY t.key)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       ((epochs + CASE WHEN target - epochs * source_size > 0 AND draw <= last_draw THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM drawn JOIN targets USING (key) LEFT JOIN cuts USING (key)
"""

_ESCAPED = r"""regexp_replace(replace({0}, '\', '\\'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"""

OP5 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length('<|turn|><|text|><|end|>') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))
           OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (WHERE role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    share = lambda x: f"list_transform({x}, lambda v: v / nullif(list_sum({x}), 0))"
    term = "CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({share(p)}, {share(q)}), lambda x: {term})) / 2, 0))"


OP6 = rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM base),
each AS (SELECT rid, lang, unnest(words) AS word, unnest(range(len(words))) AS pos FROM worded),
common AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) AS place FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank FROM each GROUP BY lang, word) WHERE rank <= 40),
sizes AS (SELECT lang, max(place) AS width FROM common GROUP BY lang),
hits AS (SELECT rid, place, count(*) AS n FROM each JOIN common USING (lang, word) GROUP BY rid, place),
windows AS (SELECT a.rid, a.pos, a.word || ' ' || b.word || ' ' || c.word AS w FROM each a JOIN each b ON b.rid = a.rid AND b.pos = a.pos + 1 JOIN each c ON c.rid = a.rid AND c.pos = a.pos + 2),
twice AS (SELECT rid, w FROM windows GROUP BY rid, w HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT pos + d) AS n FROM windows JOIN twice USING (rid, w), (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
word_hist AS (
  SELECT w.rid, w.lang, list(coalesce(h.n, 0)::DOUBLE ORDER BY p.place) AS known
  FROM worded w JOIN common p USING (lang) LEFT JOIN hits h ON h.rid = w.rid AND h.place = p.place GROUP BY w.rid, w.lang),
counted AS (
  SELECT w.rid, w.doc_id, w.lang, len(words)::BIGINT AS n_words, length(text) AS n_chars,
         len(regexp_extract_all(text, '\p{{Ll}}')) AS lower, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper, len(regexp_extract_all(text, '\p{{Nd}}')) AS digit,
         len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS space, len(regexp_extract_all(text, '[.,;:!?''"()\-]')) AS mark,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(h.known, []::DOUBLE[]) AS known
  FROM worded w LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN word_hist h USING (rid)),
hist AS (
  SELECT *, [lower, upper, digit, space, mark, n_symbols, n_chars - lower - upper - digit - space - mark - n_symbols]::DOUBLE[] AS ch,
         list_append(known, n_words - coalesce(list_sum(known), 0))::DOUBLE[] AS wh
  FROM counted),
chars_ref AS (SELECT lang, list(s ORDER BY i) AS ch_ref FROM (SELECT lang, i, sum(ch[i]) AS s FROM hist, range(1, 8) AS t(i) GROUP BY lang, i) GROUP BY lang),
words_ref AS (SELECT lang, list(s ORDER BY i) AS wh_ref FROM (SELECT lang, i, sum(wh[i]) AS s FROM hist, range(1, 42) AS t(i) WHERE i <= len(wh) GROUP BY lang, i) GROUP BY lang),
totals AS (SELECT lang, sum(n_words) AS ref_words FROM hist GROUP BY lang),
judged AS (
  SELECT h.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN ref_words >= 2000 AND n_chars >= 200 THEN {_js("ch", "ch_ref")} END AS char_distance,
         CASE WHEN ref_words >= 2000 AND n_words >= 100 THEN {_js("wh", "wh_ref")} END AS word_distance
  FROM hist h JOIN chars_ref USING (lang) JOIN words_ref USING (lang) JOIN totals USING (lang))
SELECT doc_id, n_words, (n_chars - space)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(char_distance, 0) <= 0.30 AND coalesce(word_distance, 0) <= 0.36 AS kept
FROM judged
"""

OP7 = rf"""
WITH RECURSIVE base AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
tokens AS (
  SELECT DISTINCT rid, md5(array_to_string(words[i : i + 4], ' ')) AS token
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM base WHERE len(words) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM tokens GROUP BY rid),
links AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM tokens x JOIN tokens y ON x.token = y.token AND x.rid <> y.rid GROUP BY 1, 2) p
  JOIN sizes s ON s.rid = p.a JOIN sizes t ON t.rid = p.b WHERE 100 * shared >= 80 * (s.n + t.n - shared)),
reach AS (SELECT rid AS a, rid AS b FROM base UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT base.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM base LEFT JOIN sizes USING (rid)
JOIN (SELECT a, min(doc_id) AS component_id FROM reach JOIN base ON base.rid = reach.b GROUP BY a) c ON c.a = base.rid
"""

OP8 = rf"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS hash FROM documents),
levels AS (SELECT d AS depth, hash >> (60 - d) AS prefix, sum(bytes)::BIGINT AS bytes FROM hashed, range(0, 31) AS t(d) GROUP BY 1, 2),
ends AS (
  SELECT l.depth, l.prefix FROM levels l LEFT JOIN levels p ON p.depth = l.depth - 1 AND p.prefix = l.prefix >> 1
  WHERE l.bytes <= {SHARD_BYTES} AND (l.depth = 0 OR p.bytes > {SHARD_BYTES}))
SELECT doc_id, bytes, e.prefix::BIGINT AS prefix, e.depth::INTEGER AS depth, 0 AS part
FROM hashed h JOIN ends e ON e.prefix = h.hash >> (60 - e.depth)
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
each AS (SELECT rid, lang, source, unnest(terms) AS term FROM base),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS cnt FROM each JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT lang, source, coalesce(sum(cnt), 0) AS n FROM (SELECT DISTINCT lang, source FROM base) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(cnt, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(cnt, 0) + 1)) // (n + v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(cnt) + 1)) // (any_value(total) + any_value(v)) AS q
  FROM dense JOIN sizes USING (lang) JOIN (SELECT lang, sum(n) AS total FROM groups GROUP BY lang) USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON b.lang = a.lang AND b.term = a.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM dense JOIN whole USING (lang, term) WHERE cnt > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""

OP13 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
items AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
wanted AS (SELECT DISTINCT iid, unnest(terms) AS term FROM items),
sums AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM docs WHERE len(terms) > 0),
postings AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY rid, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(s.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, sums s GROUP BY term),
lengths AS (SELECT rid, doc_id, 10 + (90 * len(terms) * s.docs) // s.total AS m FROM docs, sums s WHERE len(terms) > 0),
scored AS (
  SELECT iid, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (rid) GROUP BY iid, rid)
SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored JOIN items USING (iid) JOIN lengths USING (rid) WHERE score > 0 QUALIFY rank <= 10
"""

SQL: dict[str, str] = {"op4_mixing": OP4, "op5_chat": OP5, "op6_quality": OP6, "op7_ngram_jaccard": OP7, "op8_sharding": OP8, "op12_divergence": OP12, "op13_search": OP13}
