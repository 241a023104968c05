"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS stop FROM sources),
levels AS (
  SELECT *, stop / weight AS stop_level,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size, least(stop, weight * coalesce((SELECT max(level) FROM levels WHERE level <= stop_level), 0)) AS target,
         ('0x' || substr(md5('mix-1' || coalesce(source, chr(0))), 1, 5))::BIGINT / 1048576.0::DOUBLE AS shift
  FROM levels),
ranked AS (
  SELECT s.doc_id, s.source, s.size, a.source_size, a.target, a.shift, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.draw, s.doc_id) AS place
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
taken AS (
  SELECT *, (floor(place * rate + shift) - floor((place - 1) * rate + shift))::BIGINT AS copies FROM ranked)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM taken
"""

OP10 = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
lines AS (
  SELECT row_no, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines
  FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no),
starts AS (
  SELECT row_no, unnest(range(1, len(words) + 1)) AS pos FROM words),
passages AS (
  SELECT s.row_no, s.pos, CASE WHEN s.pos + 7 <= len(w.words) THEN array_to_string(w.words[s.pos : s.pos + 7], ' ') END AS passage
  FROM starts s JOIN words w USING (row_no)),
often AS (
  SELECT row_no, pos, CASE WHEN passage IS NOT NULL AND count(*) OVER (PARTITION BY row_no, passage) > 1 THEN 1 ELSE 0 END AS often FROM passages),
covered AS (
  SELECT row_no, max(often) OVER (PARTITION BY row_no ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM often),
repeated AS (
  SELECT row_no, sum(covered)::BIGINT AS n_repeat_words FROM covered GROUP BY row_no),
counts AS (
  SELECT w.row_no, w.doc_id, w.source AS host, len(w.words)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(w.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(l.n_lines, 0) AS n_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w.words, lambda x: x = upper(x) AND x <> lower(x) AND NOT contains(x, 'ß')))::BIGINT AS n_upper
  FROM words w LEFT JOIN lines l USING (row_no) LEFT JOIN repeated r USING (row_no)),
failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_upper > 60 * n_words AS rule_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 200 * n_symbols > 10 * n_words OR 200 * n_dup_lines > 30 * n_lines OR 200 * n_upper > 60 * n_words AS strict_failed
  FROM counts),
hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE rule_failed) AS failed FROM failed GROUP BY host),
totals AS (
  SELECT sum(n) AS every, sum(failed) / sum(n) AS mean, count(*) AS k FROM hosts),
spread AS (
  SELECT any_value(mean) AS mean, any_value(k) AS k, sum(n * (failed / n - mean) * (failed / n - mean)) AS squares, sum((1 - n / every) * (n - 1)) AS room FROM hosts, totals),
prior AS (
  SELECT mean, CASE WHEN mean * (1 - mean) > 0 AND room > 0 THEN greatest(0, least(1, (squares - mean * (1 - mean) * (k - 1)) / (mean * (1 - mean) * room))) ELSE 0 END AS rho FROM spread),
rates AS (
  SELECT host, mean, (failed * rho + mean * (1 - rho)) / (n * rho + 1 - rho) AS rate FROM hosts, prior),
verdicts AS (
  SELECT host, CASE WHEN rate > 0.9 THEN 'reject' WHEN rate > 2.0 * mean THEN 'watch' WHEN rate < 0.5 * mean THEN 'trust' ELSE 'ordinary' END AS host_verdict FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_verdict <> 'reject' AND NOT (host_verdict = 'ordinary' AND rule_failed) AND NOT (host_verdict = 'watch' AND strict_failed) AS kept, rule_failed, host_verdict
FROM failed f JOIN verdicts v ON f.host IS NOT DISTINCT FROM v.host
"""

OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT row_no, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row_no) >= 3),
marked AS (
  SELECT k.*, largest IS NOT NULL AND k.doc_id IS DISTINCT FROM largest AS dropped FROM keyed k LEFT JOIN common USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row_no
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
langs AS (
  SELECT lang, sum(n) + 2 * count(*) AS under FROM kept GROUP BY lang),
counts AS (
  SELECT w.lang, source, term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY w.lang, source, term),
sources AS (
  SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT lang, source, coalesce(sum(n), 0) + 2 * (SELECT count(*) FROM kept k WHERE k.lang = s.lang) AS under FROM sources s LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // t.under::HUGEINT)::HUGEINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 2) // l.under::HUGEINT)::HUGEINT AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {"op1_mixing": OP1, "op10_quality_rules": OP10, "op11_line_dedup": OP11, "op13_source_divergence": OP13}
