"""SQL twins of the queries, for DuckDB over the same tables."""

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
p AS (
  SELECT k, i, n, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT k, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
h AS (SELECT DISTINCT k, i, n, item_id FROM p JOIN w USING (n, gram)),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)
"""

ORACLES["op2_url_filter"] = r"""
WITH rules(host, path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parted AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?:(?s:.)*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?:(?s:.)*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
numbered AS (SELECT row_number() OVER () AS k, * FROM parted),
best AS (
  SELECT k, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
    arg_max(action, length(rules.host || rules.path)) AS verdict
  FROM numbered JOIN rules
    ON (numbered.host = rules.host OR ends_with(numbered.host, '.' || rules.host)) AND starts_with(numbered.path, rules.path)
  GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (k)
"""

ORACLES["op8_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
g AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS gram
  FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS j) GROUP BY k),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (k) LEFT JOIN l USING (k) LEFT JOIN c USING (k))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR n_exclamations > n_words OR coalesce(word_chars, 0) < 2 * n_words) AS kept
FROM m
"""

ORACLES["op3_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * i >= 75 * (u.n + v.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

ORACLES["op13_phrase_mining"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
t AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, words[i : i + m - 1] AS p FROM (
    SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(words) >= m)),
f AS (SELECT lang, p, count(*)::HUGEINT AS f FROM g GROUP BY lang, p HAVING count(*) >= 100),
c AS (
  SELECT x.lang, x.p, x.f AS a, k, u.f AS l, v.f AS r, n, 1000 * x.f * n // (u.f * v.f) AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f) x
  JOIN f u ON u.lang = x.lang AND u.p = x.p[1:k] JOIN f v ON v.lang = x.lang AND v.p = x.p[k + 1:] JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (
  SELECT lang, p[s : s + m - 1] AS p, max(f) AS most FROM (
    SELECT *, unnest(range(1, len(p) - m + 2)) AS s FROM (SELECT *, unnest(range(2, len(p))) AS m FROM f)) GROUP BY ALL),
k AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k) WHERE rank <= 2000
"""
