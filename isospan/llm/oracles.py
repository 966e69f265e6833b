"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: A-Z in lower case, other letters as they are.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k
  FROM documents),
keyed AS (
  SELECT *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM lines),
owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT doc_id, line, k, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN owners USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_QUALITY = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM docs),
windows AS (
  SELECT doc_id, k, w, lead(w) OVER d AS w1, lead(w, 2) OVER d AS w2 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
again AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS r FROM windows WHERE w2 IS NOT NULL),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM again WHERE r) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n, 0) AS n_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
         coalesce(list_max(list_transform(ws, lambda w: length(w))), 0) AS longest
  FROM docs d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN repeats r ON d.doc_id = r.doc_id),
bits AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * upper > letters THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words) THEN 32 ELSE 0 END
    + CASE WHEN longest > 1000 THEN 64 ELSE 0 END AS BIGINT) AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept, failed
FROM bits
"""

_NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s
  FROM docs),
reps AS (SELECT s, min(doc_id) AS copy_id FROM sets GROUP BY s),
shingles AS (SELECT copy_id, len(s) AS n, unnest(s) AS x FROM reps),
links AS (
  SELECT a.copy_id AS a, b.copy_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.copy_id <> b.copy_id
  GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
reach(id, root) USING KEY (id) AS (
  SELECT copy_id, copy_id FROM reps
  UNION
  SELECT l.b, min(r.root) FROM reach r JOIN links l ON l.a = r.id JOIN recurring.reach c ON c.id = l.b
  WHERE r.root < c.root GROUP BY l.b),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, reps.copy_id, reach.root AS class_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links
FROM sets JOIN reps ON sets.s = reps.s JOIN reach ON reach.id = reps.copy_id LEFT JOIN counts ON counts.a = reps.copy_id
"""

_PASSAGES = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))} AS ws,
         string_split_regex(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS gaps
  FROM documents),
words AS (
  SELECT doc_id, w, k, CAST(('0x' || left(md5(w), 8)) AS BIGINT) % 6 AS class,
         sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY k) AS stop
  FROM (SELECT doc_id, unnest(ws) AS w, unnest(gaps[1:len(ws)]) AS gap, unnest(range(len(ws))) AS k FROM docs)),
cuts AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, (class + lag(class) OVER (PARTITION BY doc_id ORDER BY k)) % 6 = 0 AS cut FROM words) WHERE cut AND k > 0
  UNION SELECT doc_id, 0 FROM docs UNION SELECT doc_id, len(ws) FROM docs),
reach AS (
  SELECT c.doc_id, c.k AS a, min(c.k) OVER (PARTITION BY c.doc_id ORDER BY c.k RANGE BETWEEN 20 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM cuts c),
segments AS (
  SELECT doc_id, a, b FROM reach WHERE b IS NOT NULL
  UNION SELECT r.doc_id, max(a), any_value(len(d.ws)) FROM reach r JOIN docs d USING (doc_id) WHERE b IS NOT NULL GROUP BY r.doc_id),
lines AS (
  SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS stop
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM docs)),
units AS (
  SELECT s.doc_id, false AS line, array_to_string(d.ws[s.a + 1:s.b], ' ') AS unit, f.stop - length(f.w) AS start, l.stop
  FROM segments s JOIN docs d USING (doc_id) JOIN words f ON f.doc_id = s.doc_id AND f.k = s.a JOIN words l ON l.doc_id = s.doc_id AND l.k = s.b - 1
  UNION ALL
  SELECT doc_id, true, array_to_string(ws, ' '), stop - size, stop FROM (
    SELECT doc_id, stop, length(line) AS size, {_WORDS.replace("coalesce(text, '')", _LOWER.format("line"))} AS ws FROM lines) WHERE length(array_to_string(ws, ' ')) >= 10),
owners AS (SELECT line, unit, min(doc_id) AS owner FROM units GROUP BY ALL),
spans AS (
  SELECT u.doc_id, start, least(u.stop + CAST(u.line AS INT), length(d.text)) AS stop
  FROM (SELECT *, first_value(stop) OVER (PARTITION BY doc_id, line, unit ORDER BY start) AS place FROM units) u
  JOIN owners o ON o.line = u.line AND o.unit = u.unit JOIN docs d ON d.doc_id = u.doc_id
  WHERE o.owner <> u.doc_id OR u.start >= u.place),
islands AS (
  SELECT doc_id, min(start) AS a, max(stop) AS b FROM (
    SELECT *, sum(CAST(start > coalesce(far, -1) AS INT)) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS n FROM (
      SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans))
  GROUP BY doc_id, n),
left_over AS (
  SELECT i.doc_id, count(*) AS n, string_agg(i.a || ':' || i.b, ',' ORDER BY i.a) AS removed,
         string_agg(substr(d.text, CAST(i.from_ + 1 AS BIGINT), CAST(i.a - i.from_ AS BIGINT)), '' ORDER BY i.a) || substr(any_value(d.text), CAST(max(i.b) + 1 AS BIGINT)) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM islands) i JOIN docs d ON d.doc_id = i.doc_id GROUP BY i.doc_id)
SELECT d.doc_id, coalesce(l.n, 0) AS n_removed, coalesce(l.removed, '') AS removed, sha256(coalesce(l.kept, d.text)) AS kept_sha256
FROM docs d LEFT JOIN left_over l ON l.doc_id = d.doc_id
"""

#: The default target of mixing: entropy of 0.9, 3 repeats, seed 17, 64 parts, no token budget.
_MIXING = rf"""
WITH RECURSIVE docs AS (
  SELECT *, coalesce('=' || source, '') AS src, greatest(len({_WORDS}), 1) AS tokens, CAST(doc_id AS VARCHAR) AS id,
         CAST('0x' || left(md5('17:cell:' || doc_id), 15) AS BIGINT) % 65536 AS cell
  FROM documents),
totals AS (SELECT src, count(*) AS docs, CAST(sum(tokens) AS BIGINT) AS whole FROM docs GROUP BY src),
shares AS (SELECT *, whole / sum(whole) OVER () AS p FROM totals),
every AS (SELECT list(p ORDER BY src) AS ps FROM shares),
entropies(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN e < 0.9 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN e < 0.9 THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT *, (ln(list_sum(w)) - list_sum(list_transform(w, lambda x: x * ln(x))) / list_sum(w)) / ln(len(w)) AS e
    FROM (SELECT step, lo, hi, list_transform(ps, lambda p: pow(p, (lo + hi) / 2)) AS w FROM entropies, every WHERE step < 20))),
repeats(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN r <= 3 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN r <= 3 THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT step, lo, hi, pow(list_max(ps) / list_min(ps), 1 - (lo + hi) / 2) AS r FROM repeats, every WHERE step < 20)),
found AS (
  SELECT CASE WHEN len(ps) > 1 AND -list_sum(list_transform(ps, lambda p: p * ln(p))) / ln(len(ps)) < 0.9 THEN (SELECT lo FROM entropies WHERE step = 20) ELSE 1.0 END AS a, ps FROM every),
exponent AS (
  SELECT round(CASE WHEN pow(list_max(ps) / list_min(ps), 1 - a) > 3 THEN (SELECT hi FROM repeats WHERE step = 20) ELSE a END, 5) AS a FROM found),
raised AS (SELECT s.*, pow(p, a) AS w FROM shares s, exponent),
weighed AS (
  SELECT src, whole, round(w / sum(w) OVER (), 12) AS weight, least(65536, CAST(ceil(docs / greatest(64, sqrt(docs))) AS BIGINT)) AS n_blocks,
         CAST(round(whole * greatest(1.0::DOUBLE, round(w / p / min(w / p) OVER (), 9))) AS BIGINT) AS budget FROM raised),
dealt AS (SELECT d.*, whole, weight, budget, CAST(floor(cell * n_blocks / 65536) AS BIGINT) AS block FROM docs d JOIN weighed USING (src)),
passes AS (SELECT src, unnest(range(CAST(ceil(budget / whole) AS BIGINT))) AS copy FROM weighed),
blocks AS (SELECT src, block, sum(tokens) AS size FROM dealt GROUP BY ALL),
starts AS (
  SELECT src, block, copy, sum(size) OVER (PARTITION BY src, copy ORDER BY CAST('0x' || left(md5('17:block:' || copy || ':' || block), 15) AS BIGINT), block) - size AS start
  FROM blocks JOIN passes USING (src)),
slots AS (SELECT d.*, copy, CAST('0x' || left(md5('17:slot:' || copy || ':' || id), 15) AS BIGINT) AS slot FROM dealt d JOIN passes USING (src)),
placed AS (
  SELECT s.*, CAST(copy * whole + start + sum(tokens) OVER (PARTITION BY src, copy, block ORDER BY slot, doc_id, tokens ROWS UNBOUNDED PRECEDING) - tokens AS BIGINT) AS place
  FROM slots s JOIN starts USING (src, block, copy))
SELECT {{columns}}, CAST(tokens AS BIGINT) AS n_tokens, weight, CAST(copy AS BIGINT) AS copy, CAST(floor(place / budget * 64) AS BIGINT) AS mix_block, slot
FROM placed WHERE place < budget
"""

#: Words by lower case and without signs at their ends: the normal form of the letters in the tables.
_NORMAL = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda w: regexp_replace(replace(lower(w), 'ß', 'ss'), '^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$', '', 'g')), lambda w: w <> '')"
_OVERLAPS = rf"""
WITH items AS (SELECT item_id, len(ws) AS n, least(16, len(ws)) AS wide, ws FROM (SELECT item_id, {_NORMAL} AS ws FROM benchmark) WHERE len(ws) >= 8),
item_words AS (SELECT item_id, n, wide, unnest(ws) AS w, unnest(range(n)) AS k FROM items),
doc_words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT doc_id, {_NORMAL} AS ws FROM documents)),
diagonals AS (
  SELECT doc_id, item_id, d.k - i.k AS shift, any_value(n) AS n, any_value(wide) AS wide, list(i.k) AS same
  FROM doc_words d JOIN item_words i USING (w) GROUP BY ALL HAVING count(*) >= ceil(any_value(wide) * 4 / 5)),
windows AS (
  SELECT * FROM (SELECT *, unnest(range(n - wide + 1)) AS s FROM diagonals)
  WHERE 5 * len(list_filter(same, lambda k: k >= s AND k < s + wide)) >= 4 * wide),
runs AS (
  SELECT doc_id, item_id, shift, any_value(same) AS same, min(s) AS a, max(s + wide) AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id, shift ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CAST(coalesce(s - lag(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY s), 0) > wide AS INT) AS fresh FROM windows))
  GROUP BY doc_id, item_id, shift, run),
held AS (SELECT doc_id, item_id, max(len(list_filter(same, lambda k: k >= a AND k < b))) AS equal FROM runs GROUP BY ALL)
SELECT d.doc_id, count(o.item_id) > 0 AS contaminated, count(o.item_id) AS n_items,
       coalesce(list(o.item_id ORDER BY o.item_id) FILTER (o.item_id IS NOT NULL), []) AS item_ids, CAST(coalesce(max(equal), 0) AS BIGINT) AS most_equal
FROM documents d LEFT JOIN held o USING (doc_id) GROUP BY d.doc_id
"""


#: Base kinds of personal data: pattern, whether match m is valid, score, words for and against it. The tables hold no
#: spans of other kinds.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, "e-?mails?|mails?|contact|write|courriel|correo", "example|sample|noreply"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0", 0.7, "ip|address|host|server|adresse", "version|release|build|section"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "len(ds) BETWEEN 16 AND 19 AND list_sum(list_transform(ds, lambda d, i: CASE WHEN (len(ds) - i) % 2 = 0 THEN d ELSE d * 2 // 10 + d * 2 % 10 END)) % 10 = 0", 0.8, "cards?|visa|credit|karte|carte|tarjeta", "order|isbn|tracking|serial"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(ds) BETWEEN 8 AND 15", 0.7, "phones?|call|tel|mobile|telefon|telephone", "order|invoice|part"),
)


def _near(words: str) -> str:
    word = f"(?:{words})"
    whole = f"(?i)(?:^|[^A-Za-z]){word}(?:[^A-Za-z]|$)"
    return (
        f"(regexp_matches(CASE WHEN length(after) > 40 THEN left(after, 41) ELSE after END, CASE WHEN length(after) > 40 THEN '(?i)(?:^|[^A-Za-z]){word}[^A-Za-z]' ELSE '{whole}' END) "
        f"OR regexp_matches(CASE WHEN length(before) > 40 THEN right(before, 41) ELSE before END, CASE WHEN length(before) > 40 THEN '(?i)[^A-Za-z]{word}(?:[^A-Za-z]|$)' ELSE '{whole}' END))"
    )


_PII = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {n} AS place, '{kind}' AS kind, start, start + length(m) AS stop, round({prior}::DOUBLE + CASE WHEN {_near(words)} THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN {_near(against)} THEN 0.2::DOUBLE ELSE 0 END, 2) AS score FROM ("
        f"SELECT *, list_transform(regexp_extract_all(m, '[0-9]'), lambda d: CAST(d AS INT)) AS ds, CAST(sum(length(before) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS start FROM ("
        f"SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS before, unnest(gs[2:]) AS after, unnest(range(len(ms))) AS i FROM ("
        f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM docs))) WHERE {valid}"
        for n, (kind, pattern, valid, prior, words, against) in enumerate(_KINDS)
    )
    + "), told AS (SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in _KINDS)
    + ", string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY place, start) AS scores FROM found GROUP BY doc_id) "
    + "SELECT d.doc_id, "
    + ", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in _KINDS)
    + ", sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM docs d LEFT JOIN told t ON t.doc_id = d.doc_id"
)


def _over(sql: str, table: str) -> str:
    """The query over another table than documents."""
    return sql.replace("FROM documents", f"FROM {table}")


#: The pipeline's stages one after the other, each over the rows that the one before left.
PIPELINE = f"""
WITH kept AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({_QUALITY}) q ON q.doc_id = d.doc_id WHERE q.kept),
lined AS MATERIALIZED (
  SELECT k.doc_id, CASE WHEN k.text IS NOT NULL THEN l.kept_text END AS text, lang, source, CAST(length(CASE WHEN k.text IS NOT NULL THEN l.kept_text END) AS BIGINT) AS n_chars
  FROM kept k JOIN ({_over(_LINE_DEDUP, "kept").replace("sha256(", "(").replace("kept_sha256", "kept_text")}) l ON l.doc_id = k.doc_id),
single AS MATERIALIZED (SELECT l.* FROM lined l JOIN ({_over(_NGRAM_JOIN, "lined")}) n ON n.doc_id = l.doc_id WHERE n.class_id = l.doc_id),
clean AS MATERIALIZED (SELECT s.* FROM single s JOIN ({_over(_OVERLAPS, "single")}) o ON o.doc_id = s.doc_id WHERE NOT o.contaminated)
SELECT * FROM ({_over(_MIXING, "clean").format(columns="doc_id, text, lang, source, n_chars")})
"""

#: Every term in every group, counted or not.
_AUDIT = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
t AS MATERIALIZED (SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS BIGINT) AS lang_c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(lang_c) AS n FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
grid AS (SELECT lang, source, term, coalesce(c, 0) AS c, lang_c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
summed AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n FROM grid),
p AS MATERIALIZED (
  SELECT lang, source, term, c, CAST(1 + (1000000000::HUGEINT * (c + 2)) // CAST(s.n + 2 * v AS HUGEINT) AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (lang_c + 2)) // CAST(l.n + 2 * v AS HUGEINT) AS BIGINT) AS q
  FROM summed s JOIN langs l USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: CRC-32 of the bytes of a text of code points under 256, byte by byte from a table made by its rule.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
  lambda a, b: xor(a >> 8, list_extract(crc_table, xor(a & 255, b) + 1))), 4294967295::BIGINT)"""
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"

#: Words meet where each is less one letter, or one of them, by place instead of by anagram.
_SPELLING = rf"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
crc AS (SELECT {_CRC_TABLE} AS crc_table),
hashed AS MATERIALIZED (SELECT run, n, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc),
spoilt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS k FROM words)),
met AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS first, max(near_n) AS most FROM met GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN first END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
way AS (SELECT word, word AS root FROM formed UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT y.word, y.root FROM way y JOIN formed e ON e.word = y.root WHERE e.form IS NULL) w ON w.word = f.word
"""

ORACLE: dict[str, str] = {
    "op11_source_audit": _AUDIT,
    "op13_spelling": _SPELLING,
    "op1_mixing": _MIXING.format(columns="doc_id, source"),
    "op9_pii": _PII,
    "op10_decontamination": _OVERLAPS,
    "op6_substring_dedup": _PASSAGES,
    "op2_ngram_join": _NGRAM_JOIN,
    "op7_line_dedup": _LINE_DEDUP,
    "op8_quality_rules": _QUALITY,
}
