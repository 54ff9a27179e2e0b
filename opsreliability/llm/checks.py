"""SQL for the queries whose results SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP3 = f"""
WITH lines AS (
  SELECT doc_id, u.pos, l[u.pos] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
       unnest(range(1, len(l) + 1)) AS u(pos)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
judged AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')").format(u=UPPER, l=UPPER.lower())

OP4 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (
  SELECT doc_id, pos, doc_id > min(doc_id) OVER (
           PARTITION BY array_to_string(w[pos:pos + 12], ' ')) AS later
  FROM d, unnest(range(1, len(w) - 11)) AS s(pos)),
gone AS (SELECT DISTINCT doc_id, pos + o.k AS pos FROM places, unnest(range(0, 13)) AS o(k) WHERE later),
words AS (SELECT doc_id, pos, w[pos] AS word FROM d, unnest(range(1, len(w) + 1)) AS s(pos)),
kept AS (
  SELECT words.doc_id, count(gone.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY words.pos) FILTER (gone.pos IS NULL) AS text
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos
  GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[s.pos:s.pos + least(len(w), 10) - 1], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS s(pos)),
places AS (
  SELECT doc_id, s.pos, k.n, array_to_string(w[s.pos:s.pos + k.n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM wins) k, unnest(range(1, len(w) - k.n + 2)) AS s(pos)),
found AS (SELECT p.doc_id, p.pos, p.n, x.item_id FROM places p JOIN wins x ON p.n = x.n AND p.win = x.win),
words AS (SELECT doc_id, count(DISTINCT pos + o.k) AS n_hit
          FROM found, unnest(range(0, n)) AS o(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP10 = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos], w[pos + 1], w[pos + 2]) > 1 AS dup
  FROM d, unnest(range(1, len(w) - 1)) AS s(pos)),
repeats AS (
  SELECT doc_id, count(DISTINCT pos + o.k) AS n FROM grams, unnest(range(0, 3)) AS o(k)
  WHERE dup GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words AS symbols,
         n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words) AS word_length,
         n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM m),
h AS (
  SELECT source, rule, count(*) AS n, sum(bad::INT) AS bad, avg(bad::INT) AS raw
  FROM (SELECT source, unnest(['base', 'symbols', 'word_length', 'dup_lines']) AS rule,
               unnest([base_failed, symbols, word_length, dup_lines]) AS bad FROM f WHERE source IS NOT NULL)
  GROUP BY source, rule),
prior AS (
  SELECT rule, avg(raw) AS mean,
         CASE WHEN var_pop(raw) > 0 THEN greatest(avg(raw) * (1 - avg(raw)) / var_pop(raw) - 1, 0)
              ELSE max(n) END AS k FROM h GROUP BY rule),
rejected AS (
  SELECT DISTINCT source FROM h JOIN prior USING (rule) WHERE (bad + mean * k) / (n + k) > 0.9)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r.source IS NULL AS kept
FROM f LEFT JOIN rejected r USING (source)"""

OP11 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (
  SELECT *, len(w)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
         ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM t),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                      OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS u, greatest(h1 % (n + 1), h2 % (n + 1)) AS v FROM h),
p AS (
  SELECT *, array_to_string(w[1:u], '') AS x, array_to_string(w[u + 1:v], '') AS y,
         array_to_string(w[v + 1:n], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y
                        ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

OP13 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
                                                  '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM pieces))
  GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
parts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cuts AS (
  SELECT parts.lang, parts.phrase, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
  FROM parts JOIN f AS x ON x.lang = parts.lang AND x.phrase = parts.x
  JOIN f AS y ON y.lang = parts.lang AND y.phrase = parts.y),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS outer_a
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM c)) GROUP BY ALL),
ranked AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM lowest LEFT JOIN inner_ USING (lang, phrase)
  WHERE outer_a IS NULL OR 100::HUGEINT * outer_a < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

ORACLE = {"op11_fill_in_middle": OP11, "op13_collocations": OP13, "op4_substring_dedup": OP4, "op3_line_dedup": OP3, "op8_decontamination": OP8, "op10_quality_rules": OP10}
