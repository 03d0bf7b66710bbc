"""DuckDB SQL for the queries it can express on whole tables."""

from __future__ import annotations

from .jaccard import PERCENT, WORDS
from .quality import LANGUAGES, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, NOISE, SYMBOLS, WORD_SHARES
from .toolcalls import MAX_TEXT, MAX_TURN

_GAP = r"[\x20\x09-\x0D]+"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_GAP}'), lambda x: x <> '')"


def _matches(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _shares(counts: str) -> str:
    return f"list_transform({counts}, lambda x: x / greatest(1, list_sum({counts})))"


def _distance(p: str, q: str) -> str:
    half = lambda z: f"CASE WHEN {z} > 0 THEN {z} * log2({z} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {half('z[1]')} + {half('z[2]')})) / 2))"


def _of_language(values: dict[str, str]) -> str:
    every = f"[{', '.join(values.values())}]"
    return f"CASE lang {' '.join(f"WHEN '{k}' THEN [{v}]" for k, v in values.items())} ELSE {every} END"


QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT k, doc_id, lang, {_words('t')} AS words, length(t) AS n_chars,
         length(regexp_replace(t, '{_GAP}', '', 'g')) AS word_chars, {_matches(f'[{SYMBOLS}]')} AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         {_matches('[0-9]')} AS digit, {_matches(r'[!-/:-@\[-`{-~]')} AS mark, {_matches(r'[^\x00-\x7F]')} AS wide,
         {_matches(r'[^\x00-\x7F\p{Latin}\p{Cyrillic}]')} AS foreign_chars
  FROM t),
positions AS (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM f),
windows AS (SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i + 1], words[i + 2]) AS n FROM positions),
repeated AS (SELECT k, count(*) AS n_repeat_words FROM (SELECT DISTINCT k, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE n > 1) GROUP BY k),
g AS (
  SELECT f.k, doc_id, lang, len(words) AS n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, n_chars,
         [word_chars - digit - mark - wide, digit, mark, wide, n_chars - word_chars] AS classes,
         coalesce(lang IN ({_quoted(LANGUAGES)}), false) OR 2 * foreign_chars <= word_chars AS familiar,
         list_transform(words, lambda x: rtrim(lower(x), '.,;:!?')) AS bare
  FROM f LEFT JOIN repeated ON repeated.k = f.k),
h AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM g),
u AS (SELECT *, NOT base_failed AND n_words >= {MIN_WORDS} AND n_chars >= {MIN_CHARS} AND familiar AS usable FROM h),
w AS (SELECT k, n_words, bare, unnest({_of_language({k: f"[{_quoted(v[0])}]" for k, v in LANGUAGES.items()})}) AS list FROM u WHERE usable),
c AS (SELECT k, list_transform(list, lambda v: len(list_filter(bare, lambda x: x = v))) AS known, n_words FROM w),
word AS (SELECT k, min({_distance(_shares('counts'), str(WORD_SHARES))}) AS d FROM (SELECT k, list_append(known, greatest(0, n_words - list_sum(known))) AS counts FROM c) GROUP BY k),
r AS (SELECT k, classes, unnest({_of_language({k: str(v[1]) for k, v in LANGUAGES.items()})}) AS ref FROM u WHERE usable),
class AS (SELECT k, min({_distance(_shares('classes'), 'ref')}) AS d FROM r GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(class.d > {MAX_CLASS_DISTANCE} OR word.d * word.d - {NOISE} / n_words > {MAX_WORD_DISTANCE * MAX_WORD_DISTANCE}, false) AS kept
FROM u LEFT JOIN word ON word.k = u.k LEFT JOIN class ON class.k = u.k"""

#: Five hex digits are four base32 characters.
RECORDS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, strlen(body) AS n, sha1(body) AS hex, row_number() OVER (PARTITION BY body ORDER BY page_id NULLS LAST) AS nth,
         min(page_id) OVER (PARTITION BY body) AS first
  FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN first END AS refers_to
FROM d"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) >= {WORDS} THEN list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' '))
                                           WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingle
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id"""

#: The first call without a result that another follows (knot) and all later ones lie in or behind a cycle.
TOOL_LINKS = f"""
WITH m AS (
  SELECT conv_id, turn, role, text,
         count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role DESC, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS k
  FROM conversations),
u AS (SELECT conv_id, k, turn, text FROM m WHERE role = 'user'),
a AS (SELECT conv_id, k, count(*) AS n, min(text) AS content FROM m WHERE role = 'assistant' GROUP BY ALL),
j AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.k, a.k) AS k, u.turn, u.text, a.n, a.content, u.k IS NOT NULL AS called
  FROM u FULL JOIN a ON u.conv_id IS NOT DISTINCT FROM a.conv_id AND u.k = a.k),
w AS (SELECT *, max(k) FILTER (called) OVER (PARTITION BY conv_id) AS last FROM j),
v AS (SELECT *, min(k) FILTER (called AND n IS NULL AND k < last) OVER (PARTITION BY conv_id) AS knot FROM w),
l AS (SELECT *, concat(conv_id, ':', k) AS call_id, CASE WHEN called AND (knot IS NULL OR k < knot) THEN k - 1 END AS level FROM v)
SELECT conv_id, call_id, level,
       row_number() OVER (PARTITION BY conv_id ORDER BY called DESC, level NULLS LAST, coalesce(turn, 0), call_id) - 1 AS position,
       CASE WHEN NOT called THEN 'no call' WHEN n > 1 THEN 'repeated' WHEN level IS NULL THEN 'cycle' WHEN n IS NULL THEN 'no result' ELSE 'linked' END AS status,
       CASE WHEN called THEN concat_ws('; ', CASE WHEN text IS NULL THEN 'text is missing' END, CASE WHEN turn IS NULL THEN 'turn is missing' END,
                                       CASE WHEN length(text) < 1 THEN 'text is shorter than 1' END, CASE WHEN length(text) > {MAX_TEXT} THEN 'text is longer than {MAX_TEXT}' END,
                                       CASE WHEN turn < 0 THEN 'turn is below 0' END, CASE WHEN turn > {MAX_TURN} THEN 'turn is above {MAX_TURN}' END) ELSE '' END AS errors,
       md5(CAST(CASE WHEN called
             THEN json_object('arguments', json_object('text', text, 'turn', turn), 'id', call_id, 'name', 'reply', 'result', content)
             ELSE json_object('arguments', json_object(), 'id', call_id, 'name', NULL, 'result', content) END AS VARCHAR)) AS json_md5
FROM l"""

AUDIT = rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w FROM documents
),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 100 AS INT)
    + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
    + 4 * CAST(100 * ({_matches("[A-Z]")}) > 10 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, FALSE) AS INT) AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM b AS a, b, b AS c, b AS d, b AS e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
),
s AS (
  SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM o, generate_series(1, 5) AS x(step)
),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0
),
p AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same QUALIFY r <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INT) AS rank,
  s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s
QUALIFY rank <= 10
"""

ORACLE_SQL = {"op2_quality_rules": QUALITY, "op6_warc_dictionary": RECORDS, "op8_tool_links": TOOL_LINKS, "op9_jaccard_join": JACCARD, "op11_filter_audit": AUDIT, "op13_hard_negatives": NEGATIVES}
