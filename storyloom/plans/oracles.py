"""DuckDB SQL for the registered queries that SQL can express, each written on its own from the operator's definition."""

from __future__ import annotations

from storyloom.plans.oracles_recall import recall_sql

TYPES = "['信息','对话','心理','动作','事件','环境']"
FUNCS = "['塑造人物','引入世界观','设置动机','推进','铺垫','反转','爆发','转场','收束分镜','悬念']"
CHAPTER_FUNCS = "['开端','推进','铺垫','爆发','转折','收束章节','过渡']"
STATES = "['主线启动','推进','受阻','达成','更换']"
STOP = "string_split('自己 什么 一个 没有 现在 这个 那个 时候', ' ')"

BASE = rf"""
WITH RECURSIVE chapter_text AS (
  SELECT source AS project, (doc_id + 1)::INT AS number, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT project, number AS chapter, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s
  FROM chapter_text),
sentences AS (
  SELECT project, chapter, pos, 'S' || (pos + 1) AS sid, pos + 1 AS seq, CASE WHEN contains(text, ',') THEN '句从' ELSE '短句' END AS struct, text
  FROM (SELECT project, chapter, unnest(range(len(s)))::INT AS pos, unnest(s) AS text FROM parts)),
shot_cells AS (
  SELECT project, chapter, ((seq - 1) // 4)::INT AS pos, min(seq) AS a, max(seq) AS b, arg_min(text, seq) AS first FROM sentences GROUP BY ALL),
shot_funcs AS (
  SELECT *, {TYPES}[(chapter * 7 + pos + 1) % 6 + 1] AS type, {FUNCS}[(chapter * 3 + (pos + 1) * 5) % 10 + 1] AS f1, {FUNCS}[(chapter + (pos + 1) * 2) % 10 + 1] AS f2 FROM shot_cells),
shots AS (
  SELECT project, chapter, pos, (pos + 1)::VARCHAR AS shot_id, type, CASE WHEN (pos + 1) % 2 = 0 AND f1 <> f2 THEN [f1, f2] ELSE [f1] END AS funcs,
         substr(regexp_replace(first, '\s', '', 'g'), 1, 6) AS label, list_transform(range(a, b + 1), lambda x: 'S' || x) AS ids, a, b FROM shot_funcs),
chapters AS (
  SELECT t.project, t.number, 't' || t.number AS title, {CHAPTER_FUNCS}[t.number % 7 + 1] AS function, coalesce(p.s[1], '') AS summary, 'e' || (t.number % 5) AS entity, {STATES}[t.number % 5 + 1] AS state
  FROM chapter_text t JOIN parts p ON p.project = t.project AND p.chapter = t.number),
annotated AS (
  SELECT source AS project, (doc_id + 1)::INT AS number FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
corpus AS (
  SELECT project || '-' || (number // 200) AS project, string_agg(number || '、d' || (number - 1) || chr(10) || text, chr(10) ORDER BY number) AS text FROM chapter_text GROUP BY 1),
lines AS (
  SELECT project, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line FROM (SELECT project, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM corpus)),
headings AS (
  SELECT project, line_no, try_cast(regexp_extract(line, '^([0-9]+)、', 1) AS INT) AS number, trim(regexp_extract(line, '^[0-9]+、(.*)$', 1)) AS title FROM lines WHERE regexp_matches(line, '^[0-9]+、')),
ranges AS (
  SELECT h.project, h.line_no, number, title, h.line_no + 1 AS start, coalesce(lead(h.line_no) OVER (PARTITION BY h.project ORDER BY h.line_no), n)::INT AS "end"
  FROM headings h JOIN (SELECT project, max(line_no) + 1 AS n FROM lines GROUP BY project) e USING (project)),
bodies AS (
  SELECT r.project, r.number, r.title, r.start, r."end", coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no), '') AS body
  FROM ranges r LEFT JOIN lines l ON l.project = r.project AND l.line_no >= r.start AND l.line_no < r."end" GROUP BY ALL),
bad_sentences AS (
  SELECT project, chapter, pos, CASE WHEN (chapter * 31 + seq) % 83 = 0 THEN 'S0' ELSE sid END AS sid, seq, CASE WHEN (chapter * 31 + seq) % 97 = 0 THEN '对话' ELSE struct END AS struct,
         CASE WHEN (chapter * 31 + seq) % 89 = 0 THEN '' WHEN (chapter * 31 + seq) % 194 = 0 THEN '“' || text || '”' ELSE text END AS text FROM sentences),
bad_shots AS (
  SELECT project, chapter, pos, shot_id, CASE WHEN n % 79 = 0 THEN '梦' ELSE type END AS type, CASE WHEN n % 71 = 0 THEN [] WHEN n % 73 = 0 THEN ['推进', '不明', '铺垫', '反转'] ELSE funcs END AS funcs,
         CASE WHEN n % 53 = 0 THEN ' ' ELSE label END AS label,
         CASE WHEN n % 61 = 0 THEN (CASE WHEN list_contains(ids, 'S1') THEN ids ELSE list_prepend('S1', ids) END) WHEN n % 67 = 0 THEN ids[2:10] ELSE ids END AS ids
  FROM (SELECT *, chapter * 17 + pos AS n FROM shots)),
bad_chapters AS (
  SELECT project, number AS chapter, CASE WHEN number % 29 = 0 THEN '无' ELSE function END AS function, CASE WHEN number % 31 = 0 THEN '' ELSE summary END AS summary, CASE WHEN number % 23 = 0 THEN '?' ELSE state END AS state FROM chapters),
owners AS (
  SELECT project, chapter, sid, arg_max(shot_id, pos) AS owner FROM (SELECT project, chapter, pos, shot_id, unnest(ids) AS sid FROM bad_shots) GROUP BY ALL),
counts AS (
  SELECT project, chapter, count(*) AS sentence_count, count(*) FILTER (WHERE length(regexp_replace(text, '[\s\x{{00a0}}\x{{3000}}]', '', 'g')) <= 12) AS short_count, count(*) FILTER (WHERE struct = '句从') AS cluster_count FROM sentences GROUP BY ALL),
shot_counts AS (
  SELECT project, chapter, count(*) AS shot_count FROM shots GROUP BY ALL),
events_layer AS (
  SELECT DISTINCT project, type, chapter FROM shots),
life AS (
  SELECT project, type, list(chapter ORDER BY chapter) AS c FROM events_layer GROUP BY ALL),
lifecycle AS (
  SELECT project, list_position({TYPES}, type) - 1 AS idx, type AS entity, c[1] AS start_ch, CASE WHEN len(c) % 7 = 0 THEN []::INT[] ELSE c END AS chapters,
         CASE WHEN len(c) % 3 = 0 THEN (CASE WHEN len(c) % 2 = 0 THEN c[-1] WHEN len(c) % 5 = 0 THEN c[-1] + 1 END) END AS end_ch, len(c) % 11 <> 0 AS has_end,
         CASE WHEN len(c) % 3 = 0 THEN '已回收' WHEN len(c) % 13 = 0 THEN '?' ELSE '悬置' END AS state, CASE WHEN len(c) % 4 = 0 THEN ' ' ELSE 'n' END AS note FROM life),
target_rows AS (
  SELECT project, substr(entity, 2, 1)::INT AS idx, entity AS target, count(*) AS n_evidence, CASE WHEN count(*) % 9 = 0 THEN '?' ELSE '推进' END AS state, substr(entity, 2, 1)::INT = count(*) % 5 AS is_main FROM chapters GROUP BY project, entity),
snapshot AS (
  SELECT project, number FROM chapter_text WHERE number % 3 = 0 AND project <> 'src3'),
fresh AS (
  SELECT * FROM annotated a WHERE NOT EXISTS (FROM snapshot s WHERE s.project = a.project AND s.number = a.number)),
outcomes AS (
  SELECT 'p' || user_id AS project, ts, event_id, (event_id % 7)::INT AS chapter, event_type = 'error' AS failed, (props->>'k')::BIGINT AS tokens, value AS elapsed FROM events),
ledger AS (
  SELECT o.project, o.chapter, count(*) AS attempts FROM outcomes o LEFT JOIN (SELECT project, chapter, max((ts, event_id)) AS ok FROM outcomes WHERE NOT failed GROUP BY ALL) k USING (project, chapter)
  WHERE o.failed AND (k.ok IS NULL OR (o.ts, o.event_id) > k.ok) GROUP BY ALL),
tasks AS (
  SELECT user_id AS id, 'src' || (user_id % 20) AS project, (user_id * 3)::INT AS from_ch, (user_id * 3 + 40)::INT AS to_ch,
         CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'killed' ELSE 'done' END AS status FROM events GROUP BY user_id),
range_states AS (
  SELECT t.id, t.project, count(c.number) AS todo, count(*) FILTER (WHERE c.number IS NOT NULL AND a.number IS NULL) AS missing
  FROM tasks t LEFT JOIN chapter_text c ON c.project = t.project AND c.number BETWEEN t.from_ch AND t.to_ch LEFT JOIN annotated a ON a.project = c.project AND a.number = c.number GROUP BY ALL),
meta AS (
  SELECT project, count(*) AS chapters_total, count(a.number) AS chapters_annotated FROM chapter_text c LEFT JOIN annotated a USING (project, number) GROUP BY project),
asks AS (
  SELECT conv_id AS session_id, (turn + 1)::INT AS seq, {TYPES}[(conv_id * 7 + turn) % 6 + 1] AS type,
         CASE WHEN turn % 2 = 0 AND f1 <> f2 THEN [f1, f2] ELSE [f1] END AS funcs, substr(regexp_replace(coalesce(text, ''), '\s', '', 'g'), 1, 6) AS label, coalesce(text, '') AS content,
         conv_id || '-' || (turn + 1) AS query_id, 'src' || (conv_id % 20) AS project
  FROM (SELECT *, {FUNCS}[(conv_id * 3 + turn * 5) % 10 + 1] AS f1, {FUNCS}[(conv_id + turn * 2) % 10 + 1] AS f2 FROM conversations)),
clean AS (
  SELECT project, regexp_replace(text, '[，。！？…、；："''“”‘’—–·《》「」『』【】〈〉\s\x{{00a0}}\x{{3000}}]', '', 'g') AS clean FROM sentences),
grams AS (
  SELECT project, substr(clean, i, 1) AS a, CASE WHEN i < length(clean) THEN substr(clean, i, 2) END AS ab FROM (SELECT project, clean, unnest(range(1, length(clean) + 1)) AS i FROM clean)),
ones AS (SELECT project, a AS gram, count(*) AS n FROM grams GROUP BY ALL),
twos AS (SELECT project, ab AS gram, count(*) AS n FROM grams WHERE ab IS NOT NULL GROUP BY ALL),
shot_texts AS (
  SELECT s.project, s.chapter, s.pos, s.shot_id, trim(string_agg(t.text, '' ORDER BY t.seq)) AS text FROM shots s JOIN sentences t ON t.project = s.project AND t.chapter = s.chapter AND t.seq BETWEEN s.a AND s.b GROUP BY ALL),
files AS (SELECT project, number AS chapter, (number * 10)::VARCHAR AS mtime FROM chapter_text),
vindex AS (
  SELECT project, chapter, chapter % 9 AS shot_count, CASE WHEN chapter % 6 = 0 THEN '0' ELSE mtime END AS source_mtime, project = 'src9' AS changed FROM files WHERE chapter % 4 <> 0),
vectors AS (
  SELECT vec_id, 'b' || (vec_id % 5) AS project, (vec_id // 20)::INT AS chapter, (vec_id % 20)::VARCHAR AS shot_id, embedding::DOUBLE[] AS e FROM embeddings)
"""

_DIST = "SELECT project, chapter, string_agg(v || ':' || n, ',' ORDER BY v) AS d FROM (SELECT project, chapter, v, count(*) AS n FROM (SELECT project, chapter, {of} AS v FROM shots) GROUP BY ALL) GROUP BY ALL"

_FLAG = "SELECT project, chapter, '{layer}' AS layer, '{rule}' AS rule, '' AS detail FROM ({rows}) WHERE {cond}"


def _flags(layer: str, rows: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(_FLAG.format(layer=layer, rule=rule, rows=rows, cond=cond) for rule, cond in rules.items())


_PER_SENTENCES = "SELECT project, chapter, bool_or(sid <> 'S' || (pos + 1)) AS o, bool_or(struct NOT IN ('短句', '句从')) AS s, bool_or(text = '') AS b FROM bad_sentences GROUP BY ALL"
_SENTENCE_FLAGS = _flags("sentences", _PER_SENTENCES, {"sequence": "o", "struct": "s", "blank_text": "b"})
_CHAPTER_FLAGS = _flags("chapter", "FROM bad_chapters", {"function": "function = '无'", "summary": "regexp_replace(summary, '\\s', '', 'g') = ''", "mainline_state": "state = '?'"})
_SHOT_IDS = "SELECT project, chapter, pos, unnest(range(len(ids))) AS k, unnest(ids) AS sid FROM bad_shots"
_PER_SHOTS = f"""SELECT c.project, c.chapter, coalesce(n, 0) AS n, coalesce(d, 0) AS d, c.s, coalesce(broken, false) AS broken, coalesce(t, false) AS t, coalesce(f, false) AS f
  FROM (SELECT project, chapter, count(*) AS s FROM sentences GROUP BY ALL) c
  LEFT JOIN (SELECT project, chapter, count(*) AS n, count(DISTINCT sid) AS d, bool_or(sid <> 'S' || i) AS broken FROM (SELECT *, row_number() OVER (PARTITION BY project, chapter ORDER BY pos, k) AS i FROM ({_SHOT_IDS})) GROUP BY ALL) i USING (project, chapter)
  LEFT JOIN (SELECT project, chapter, bool_or(type = '梦') AS t, bool_or(len(funcs) = 0 OR list_contains(funcs, '不明')) AS f FROM bad_shots GROUP BY ALL) k USING (project, chapter)"""
_TARGET_ISSUES = """SELECT project, 'incomplete' AS rule FROM target_rows GROUP BY project HAVING bool_or(state = '?')
  UNION ALL SELECT project, 'main_not_unique' FROM target_rows GROUP BY project HAVING count(*) FILTER (WHERE is_main) <> 1
  UNION ALL SELECT project, 'main_not_largest' FROM target_rows GROUP BY project HAVING count(*) FILTER (WHERE is_main) = 1 AND max(n_evidence) FILTER (WHERE is_main) <> max(n_evidence)"""
_REPAIRS = """SELECT project, chapter, 'shots' AS layer, 'shots[' || pos || '].type' AS loc, 'type' AS problem, type AS current FROM bad_shots WHERE type = '梦'
  UNION ALL SELECT project, chapter, 'shots', 'shots[' || pos || '].funcs', 'funcs_unknown', array_to_string(funcs, ',') FROM bad_shots WHERE list_contains(funcs, '不明')
  UNION ALL SELECT project, chapter, 'shots', 'shots[' || pos || '].funcs', 'funcs_empty', '' FROM bad_shots WHERE len(funcs) = 0
  UNION ALL SELECT project, chapter, 'shots', 'shots[' || pos || '].funcs', 'funcs_many', array_to_string(funcs, ',') FROM bad_shots WHERE len(funcs) > 3
  UNION ALL SELECT project, chapter, 'shots', 'shots[' || pos || '].label', 'label_blank', label FROM bad_shots WHERE trim(label) = ''
  UNION ALL SELECT project, chapter, 'chapter', 'function', 'function', function FROM bad_chapters WHERE function = '无'
  UNION ALL SELECT project, chapter, 'chapter', 'summary', 'summary_blank', '' FROM bad_chapters WHERE summary = ''
  UNION ALL SELECT project, chapter, 'chapter', 'mainlineProgress[0].state', 'state', state FROM bad_chapters WHERE state = '?'
  UNION ALL SELECT project, chapter, 'sentences', 'sentences[' || pos || '].struct', 'struct', struct FROM (
    SELECT *, row_number() OVER (PARTITION BY project, chapter ORDER BY pos) AS i FROM bad_sentences WHERE struct = '对话' AND NOT (contains(text, '“') AND contains(text, '”'))) WHERE i <= 5"""
_RANKED_SHOTS = """SELECT g.type, g.funcs, s.project, s.chapter, s.pos, s.shot_id, list_has_all(s.funcs, g.funcs) AND s.type = g.type AS exact,
    2.0 * len(list_filter(g.funcs, lambda f: list_contains(s.funcs, f))) + CASE WHEN s.type = g.type THEN 0.5 ELSE 0 END AS score
  FROM (SELECT DISTINCT type, list_sort(funcs) AS funcs FROM asks) g CROSS JOIN shots s"""

_APPLIED = """,
entries AS MATERIALIZED (SELECT project, 'event' AS layer, (row_number() OVER (PARTITION BY project ORDER BY idx) - 1)::INT AS idx, entity AS name, chapters, state, end_ch FROM lifecycle),
later AS MATERIALIZED (SELECT project, type, list_sort(list(chapter + 1)) AS chapters FROM events_layer GROUP BY ALL),
merging AS MATERIALIZED (SELECT e.project, e.idx, e.name AS type, l.chapters FROM entries e JOIN later l ON l.project = e.project AND l.type = e.name),
books AS MATERIALIZED (SELECT project, max(idx) + 1 AS n FROM entries GROUP BY project),
instructions AS MATERIALIZED (
  SELECT project, 'event' AS layer, idx * 10 AS seq, 'merge' AS action, idx, CASE WHEN idx % 4 = 3 THEN 'other' WHEN idx % 2 = 0 THEN type END AS entity, chapters, CASE WHEN idx % 2 = 0 THEN '已回收' ELSE '悬置' END AS state, CASE WHEN idx % 3 = 0 THEN chapters[1] END AS end_ch, NULL::VARCHAR AS name FROM merging
  UNION ALL SELECT project, 'event', 5, 'merge', idx, type, chapters, '已回收', 9999, NULL FROM merging WHERE idx = 0
  UNION ALL SELECT project, 'event', 40, 'insert', NULL, NULL, [1], '悬置', NULL, 'new' FROM books
  UNION ALL SELECT project, 'event', 35, 'merge', n, NULL, [777], NULL, NULL, NULL FROM books
  UNION ALL SELECT project, 'event', 45, 'merge', n, NULL, [5], NULL, NULL, NULL FROM books
  UNION ALL SELECT project, 'event', 50, 'merge', 99, NULL, [], NULL, NULL, NULL FROM books
  UNION ALL SELECT project, 'event', 60, 'drop', 0, NULL, [], NULL, NULL, NULL FROM books),
all_entries AS MATERIALIZED (
  SELECT *, -1 AS born FROM entries
  UNION ALL SELECT i.project, i.layer, (b.n + row_number() OVER (PARTITION BY i.project, i.layer ORDER BY i.seq) - 1)::INT, i.name, i.chapters, i.state, i.end_ch, i.seq FROM instructions i JOIN books b USING (project) WHERE i.action = 'insert' AND i.name IS NOT NULL),
fits AS (
  SELECT e.project, e.layer, e.idx, list_distinct(flatten(list(i.chapters))) AS more, bool_or(i.state = '已回收') AS closes, arg_min(i.end_ch, i.seq) FILTER (WHERE i.end_ch IS NOT NULL) AS first_end, count(*) AS merged
  FROM instructions i JOIN all_entries e ON e.project = i.project AND e.layer = i.layer AND e.idx = i.idx AND i.action = 'merge' AND i.seq > e.born AND (i.entity IS NULL OR i.entity = '' OR i.entity = e.name) GROUP BY ALL),
applied AS (
  SELECT e.project, e.layer, e.idx, e.name, CASE WHEN f.merged IS NULL THEN e.chapters ELSE list_sort(list_distinct(list_concat(e.chapters, f.more))) END AS chapters,
    CASE WHEN e.layer = 'event' AND e.state = '悬置' AND f.closes THEN '已回收' ELSE e.state END AS state, coalesce(e.end_ch, f.first_end) AS end_ch, coalesce(f.merged, 0) + CASE WHEN e.born >= 0 THEN 1 ELSE 0 END AS applied
  FROM all_entries e LEFT JOIN fits f ON f.project = e.project AND f.layer = e.layer AND f.idx = e.idx)"""

_VECTOR_PLAN = """SELECT f.project, f.chapter, coalesce(f.project = 'src9' AND EXISTS (FROM vindex x WHERE x.project = f.project), false) OR i.source_mtime IS DISTINCT FROM f.mtime AS rebuild FROM files f LEFT JOIN vindex i USING (project, chapter)"""

_SQL = {
    "sentences": "SELECT * FROM sentences",
    "shots": "SELECT project, chapter, pos, shot_id, type, array_to_string(funcs, ',') AS funcs, label, array_to_string(ids, ',') AS sentence_ids FROM shots",
    "corpus_lines": "SELECT * FROM lines",
    "chapter_headings": "SELECT * FROM headings",
    "chapter_ranges": "SELECT * FROM ranges",
    "chapter_sizes": 'SELECT project, start, "end", length(body) AS chars, md5(body) AS body_md5 FROM bodies',
    "chapter_list_rows": """SELECT project, number, title || CASE WHEN number % 3 <> 0 THEN ',x' ELSE '' END AS title, start, "end", CASE WHEN number % 3 <> 0 THEN 7 END AS chars FROM ranges""",
    "listed_bodies": "SELECT project, number, length(body) AS chars, md5(body) AS body_md5 FROM bodies",
    "chapter_numerals": """SELECT number, CASE WHEN number < 10 THEN d[number + 1] WHEN number < 20 THEN '十' || o WHEN number < 100 THEN d[t + 1] || '十' || o
        WHEN number < 1000 THEN h || r ELSE k || CASE WHEN number % 1000 = 0 THEN '' WHEN number % 1000 < 10 THEN '零' || o WHEN number % 1000 < 20 THEN '零十' || o WHEN number % 1000 < 100 THEN '零' || d[t + 1] || '十' || o ELSE h || r END END AS numeral, number AS value
      FROM (SELECT *, d[number // 1000 + 1] || '千' AS k, d[number // 100 % 10 + 1] || '百' AS h, CASE WHEN o = '' AND t = 0 THEN '' WHEN t = 0 THEN '零' || o WHEN t = 1 THEN '十' || o ELSE d[t + 1] || '十' || o END AS r
        FROM (SELECT *, CASE WHEN number % 10 = 0 THEN '' ELSE d[number % 10 + 1] END AS o, number // 10 % 10 AS t FROM (SELECT DISTINCT number, ['零','一','二','三','四','五','六','七','八','九'] AS d FROM chapter_text)))""",
    "synthetic_corpus": """SELECT project, number, CASE WHEN number % 2 = 0 THEN 't' || number ELSE '第' || number || '章' END AS title, e - n AS start, e AS "end", length(regexp_replace(text, '[\\s\\x{00a0}\\x{3000}]', '', 'g')) AS chars
      FROM (SELECT *, sum(n + 1) OVER (PARTITION BY project ORDER BY number) AS e FROM (SELECT *, len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS n FROM chapter_text))""",
    "sentence_gate": f"{_SENTENCE_FLAGS} UNION ALL SELECT project, chapter, 'sentences', 'empty', '' FROM parts WHERE len(s) = 0",
    "shot_gate": _flags("shots", _PER_SHOTS, {"overlap": "n <> d", "coverage": "n <> s", "sequence": "broken", "type": "t", "funcs": "f"}),
    "chapter_gate": _CHAPTER_FLAGS,
    "layer_completeness": """SELECT project, chapter, 'chapter' AS layer, 'missing_layer' AS rule, detail FROM (
        SELECT c.project, c.number AS chapter, c.number % 19 <> 0 AS t, c.number % 17 <> 0 AND len(p.s) > 0 AS s, c.number % 13 <> 0 AND len(p.s) > 0 AS h, c.number % 11 <> 0 AS a FROM chapter_text c JOIN parts p ON p.project = c.project AND p.chapter = c.number),
        (VALUES ('text'), ('sentences'), ('shots'), ('chapter')) v(detail) WHERE (t OR s OR h OR a) AND NOT CASE detail WHEN 'text' THEN t WHEN 'sentences' THEN s WHEN 'shots' THEN h ELSE a END""",
    "event_contract": """SELECT project, idx, rule FROM (SELECT *, has_end AND end_ch IS NULL AS null_end FROM lifecycle), (VALUES ('incomplete'), ('closed_without_end'), ('open_with_end'), ('end_outside')) v(rule)
      WHERE coalesce(CASE rule WHEN 'incomplete' THEN state = '?' OR note = ' ' WHEN 'closed_without_end' THEN state = '已回收' AND null_end WHEN 'open_with_end' THEN state = '悬置' AND NOT null_end ELSE NOT null_end AND NOT coalesce(list_contains(chapters, end_ch), false) END, false)""",
    "event_repair": """SELECT project, idx, entity, start_ch, array_to_string(CASE WHEN e IS NULL OR list_contains(c, e) THEN c ELSE list_sort(list_append(c, e)) END, ',') AS chapters, e AS end_ch, has_end, state, note
      FROM (SELECT *, CASE WHEN len(chapters) = 0 THEN [start_ch] ELSE chapters END AS c, CASE WHEN state = '已回收' AND end_ch IS NULL THEN start_ch ELSE end_ch END AS e FROM lifecycle)""",
    "target_contract": _TARGET_ISSUES,
    "main_target": "SELECT project, idx, target, n_evidence, row_number() OVER (PARTITION BY project ORDER BY n_evidence DESC, idx) = 1 AS is_main FROM target_rows",
    "document_contract": """SELECT project, layer, rule FROM (SELECT project, count(*) AS n FROM chapter_text GROUP BY project), (VALUES ('chapter_table'), ('event'), ('volume')) l(layer), (VALUES ('schema'), ('derived_from'), ('temp_for')) v(rule)
      WHERE CASE rule WHEN 'schema' THEN (layer = 'event' AND n % 2 <> 0) OR (layer = 'chapter_table' AND n % 5 = 0) WHEN 'derived_from' THEN layer <> 'volume' AND n % 3 = 0 ELSE layer = 'volume' AND n % 4 = 0 END""",
    "issue_totals": f"""SELECT b.project, coalesce(a.n, 0) + coalesce(t.n, 0) AS issues, coalesce(a.n, 0) + coalesce(t.n, 0) = 0 AS passed FROM (SELECT DISTINCT project FROM chapter_text) b
      LEFT JOIN (SELECT project, count(DISTINCT chapter) AS n FROM ({_SENTENCE_FLAGS} UNION ALL {_CHAPTER_FLAGS}) GROUP BY project) a USING (project) LEFT JOIN (SELECT project, count(*) AS n FROM ({_TARGET_ISSUES}) GROUP BY project) t USING (project)""",
    "repair_list": _REPAIRS,
    "problem_classes": f"""SELECT project, chapter, class, count(*) AS n, count(*) > 2 AS too_many FROM (SELECT *, CASE WHEN contains(problem, 'funcs') THEN 'funcs' WHEN contains(problem, 'type') THEN 'type' WHEN contains(problem, 'struct') THEN 'struct' ELSE 'other' END AS class FROM ({_REPAIRS})) GROUP BY ALL""",
    "struct_repair": """SELECT project, count(*) FILTER (WHERE struct = '短句' OR q AND struct = '对话') AS short, count(*) FILTER (WHERE struct = '对话' AND NOT q) AS odd, count(*) FILTER (WHERE struct = '对话' AND NOT q) AS unresolved
      FROM (SELECT *, contains(text, '“') AND contains(text, '”') AS q FROM bad_sentences) GROUP BY project""",
    "request_audit": "SELECT session_id, count(*) AS n_shots, count(*) FILTER (WHERE (session_id + seq) % 7 = 0) AS bad_types, count(*) FILTER (WHERE (session_id + seq) % 5 = 0) AS bad_funcs FROM asks GROUP BY session_id",
    "shot_backfill": "SELECT project, chapter, sid, owner AS shot_id FROM sentences LEFT JOIN owners USING (project, chapter, sid)",
    "shot_orphans": "SELECT project, chapter, sid FROM sentences s WHERE NOT EXISTS (FROM owners o WHERE o.project = s.project AND o.chapter = s.chapter AND o.sid = s.sid)",
    "sentence_ranges": "SELECT project, chapter, shot_id, list_min(n) AS first, list_max(n) AS last FROM (SELECT project, chapter, shot_id, list_transform(ids, lambda x: substr(x, 2)::INT) AS n FROM bad_shots)",
    "chapter_stats": f"SELECT project, chapter, sentence_count, short_count, cluster_count, shot_count, t.d AS shot_type_dist, f.d AS func_dist FROM counts JOIN shot_counts USING (project, chapter) JOIN ({_DIST.format(of='type')}) t USING (project, chapter) JOIN ({_DIST.format(of='unnest(funcs)')}) f USING (project, chapter)",
    "type_distribution": "SELECT project, chapter, type AS value, count(*) AS n FROM shots GROUP BY ALL",
    "func_distribution": "SELECT project, chapter, value, count(*) AS n FROM (SELECT project, chapter, unnest(funcs) AS value FROM shots) GROUP BY ALL",
    "suspense_list": "SELECT project, chapter, pos, shot_id, label, a || ',' || b AS sentence_range FROM shots WHERE list_contains(funcs, '悬念')",
    "chapter_table": "SELECT project, number, title, function, summary, '章节/第' || CASE WHEN number < 10000 THEN lpad(number::VARCHAR, 4, '0') ELSE number::VARCHAR END || '章.json' AS stats_ref FROM chapters",
    "mainline_feed": "SELECT project, number, 0 AS pos, entity, state FROM chapters",
    "book_totals": """SELECT c.project, min(number) AS first_chapter, max(number) AS last_chapter, count(*) AS chapters, coalesce(sum(shot_count), 0)::BIGINT AS shots, coalesce(sum(sentence_count), 0)::BIGINT AS sentences, 0 AS words
      FROM chapters c LEFT JOIN counts k ON k.project = c.project AND k.chapter = c.number LEFT JOIN shot_counts h ON h.project = c.project AND h.chapter = c.number GROUP BY c.project""",
    "chapter_list_restore": 'SELECT project, number, title, start, "end", ("end" - start + 1) * 50 AS chars FROM ranges',
    "missing_chapters": "SELECT project, number FROM chapter_text EXCEPT SELECT * FROM annotated",
    "summary_feed": "SELECT project, string_agg('第' || CASE WHEN number < 10000 THEN lpad(number::VARCHAR, 4, '0') ELSE number::VARCHAR END || '章 ' || title || '（' || function || '）：' || summary, chr(10) ORDER BY number) AS feed FROM chapters GROUP BY project",
    "project_meta": f"""SELECT m.project, chapters_total, chapters_annotated, chapters_total - chapters_annotated AS chapters_missing, s.n AS sentences, h.n AS shots, coalesce(b.n, 0) AS bad_files, coalesce(i.n, 0) AS contract_issues, i.report, coalesce(b.n, 0) = 0 AS syntax_pass
      FROM meta m LEFT JOIN (SELECT project, count(*) AS n FROM sentences GROUP BY 1) s USING (project) LEFT JOIN (SELECT project, count(*) AS n FROM shots GROUP BY 1) h USING (project)
      LEFT JOIN (SELECT project, count(*) AS n FROM chapter_text WHERE number % 43 = 0 GROUP BY 1) b USING (project)
      LEFT JOIN (SELECT project, count(*) AS n, string_agg(chapter || ':' || rule, ',' ORDER BY k) FILTER (WHERE k <= 20) AS report FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY chapter, layer, rule) AS k FROM ({_CHAPTER_FLAGS})) GROUP BY project) i USING (project)""",
    "new_chapters": "SELECT * FROM fresh",
    "snapshot_update": "SELECT project, layer, string_agg(number::VARCHAR, ',' ORDER BY number) AS aggregated FROM (SELECT * FROM snapshot UNION SELECT project, number FROM fresh WHERE project IN (SELECT project FROM snapshot)), (VALUES ('event'), ('volume')) v(layer) GROUP BY project, layer",
    "batch_reentry": "SELECT project, CASE WHEN max(number) % 2 <> 0 THEN 't' || max(number) END AS temp_ts FROM fresh GROUP BY project",
    "pending_ledger": "SELECT * FROM ledger",
    "work_selection": "SELECT DISTINCT project, chapter AS number FROM ledger WHERE attempts % 2 <> 0 UNION ALL SELECT DISTINCT project, chapter FROM outcomes WHERE chapter BETWEEN 2 AND 3",
    "pending_leftovers": "SELECT * FROM ledger l WHERE NOT EXISTS (FROM outcomes o WHERE o.project = l.project AND o.chapter = l.chapter AND NOT o.failed)",
    "range_missing": """SELECT t.id, t.project, row_number() OVER (PARTITION BY t.id, t.project ORDER BY c.number) AS pos, c.number FROM tasks t JOIN chapter_text c ON c.project = t.project AND c.number BETWEEN t.from_ch AND t.to_ch
      WHERE NOT EXISTS (FROM annotated a WHERE a.project = c.project AND a.number = c.number)""",
    "range_state": "SELECT *, CASE WHEN todo = 0 THEN 'empty_range' WHEN missing = 0 THEN 'complete' ELSE 'open' END AS reason FROM range_states",
    "next_batch": 'SELECT project, count(*) + 1 AS start, count(*) + 30 AS "end" FROM annotated GROUP BY project',
    "failure_fuse": "SELECT *, prior_failures * 10 > processed * 3 AS blown FROM (SELECT project, event_id AS seq_id, coalesce(sum(failed::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_failures, row_number() OVER w AS processed FROM outcomes WINDOW w AS (PARTITION BY project ORDER BY ts, event_id))",
    "pending_reasons": """SELECT l.project, l.chapter, l.attempts, arg_max('k' || o.tokens, (o.ts, o.event_id)) AS reason FROM ledger l JOIN outcomes o ON o.project = l.project AND o.chapter = l.chapter AND o.failed GROUP BY ALL""",
    "json_objects": "SELECT event_id, event_id % 12 NOT IN (1, 2, 3, 4, 5, 6, 7, 8) AND json_valid(props) AND json_type(props) = 'OBJECT' AS valid FROM events",
    "usage_kinds": """SELECT project, count(*) AS calls, coalesce(sum(tokens // 3), 0)::BIGINT AS prompt_tokens, coalesce(sum(tokens - tokens // 3), 0)::BIGINT AS completion_tokens, coalesce(sum(tokens), 0)::BIGINT AS total_tokens FROM outcomes GROUP BY project""",
    "aggregate_texts": """SELECT * FROM (
      SELECT project, 'event' AS layer, unnest([CASE WHEN p % 3 = 0 THEN 'deprecated_key' END, CASE WHEN p % 4 IN (1, 2) THEN 'no_snapshot' END, CASE WHEN odd THEN 'end_not_number' END]) AS rule
      FROM (SELECT project, substr(project, 4)::INT AS p, bool_or(end_ch IS NOT NULL AND start_ch % 5 = 0) AS odd FROM lifecycle GROUP BY project)
      UNION ALL SELECT project, 'volume', 'deprecated_key' FROM (SELECT DISTINCT project, substr(project, 4)::INT AS p FROM target_rows) WHERE p % 5 = 0) WHERE rule IS NOT NULL""",
    "book_names": r"""SELECT query_id, CASE WHEN name = '' OR length(name) > 50 THEN 'length' WHEN NOT regexp_matches(name, '^[一-龥A-Za-z0-9_·《》（）()]+$') THEN 'characters' WHEN name IN (SELECT project FROM chapter_text) THEN 'taken' END AS problem
      FROM (SELECT query_id, trim(CASE seq WHEN 1 THEN ' ' || project || ' ' WHEN 2 THEN label WHEN 3 THEN '  ' ELSE regexp_replace(content, '[ .,]', '', 'g') END) AS name FROM asks)""",
    "stored_documents": "SELECT project AS id, chapters_total AS chapters, CASE WHEN substr(project, 4)::INT % 2 = 0 THEN 't' END AS title FROM meta",
    "usage_cost": "SELECT project, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(elapsed), 2) AS elapsed FROM outcomes GROUP BY project",
    "kb_status": """SELECT b.project, CASE WHEN b.project IN ('src1', 'src2') THEN NULL WHEN b.project > 'src5' THEN 'ex' ELSE 'my' END AS domain,
        CASE WHEN b.project IN ('src1', 'src2') THEN 'unbuilt' WHEN coalesce(chapters_annotated, 0) < coalesce(chapters_total, 0) THEN 'building' ELSE 'built' END AS state, chapters_annotated, chapters_total
      FROM (SELECT DISTINCT project FROM chapter_text) b LEFT JOIN (SELECT * FROM meta WHERE project <> 'src4') m USING (project)""",
    "project_listing": "SELECT DISTINCT project, CASE WHEN project < 'src5' THEN 'my' ELSE 'ex' END AS domain FROM chapter_text WHERE project < 'src5' OR project > 'src2'",
    "project_overview": "SELECT m.*, (SELECT count(*) FROM chapter_text c WHERE c.project = m.project AND number % 2 = 0 AND NOT EXISTS (FROM annotated a WHERE a.project = c.project AND a.number = c.number)) AS pending FROM meta m",
    "book_overview": "SELECT project, count(*) AS chapters, max(number) * 60 AS updated FROM chapter_text GROUP BY project",
    "session_overview": """SELECT session_id, created, shots, has_recalls, has_draft, has_draft AND row_number() OVER (ORDER BY has_draft DESC, created DESC, session_id DESC) = 1 AS latest_final
      FROM (SELECT session_id, max(seq) * 1000 + session_id % 7 AS created, count(*) AS shots, bool_or(seq = 2) AS has_recalls, bool_or(seq = 3) AS has_draft FROM asks GROUP BY session_id)""",
    "task_merge": "SELECT id, CASE WHEN id % 4 = 0 OR (id % 3 <> 0 AND status = 'running') THEN status ELSE 'saved' END AS status, CASE WHEN id % 4 = 0 OR (id % 3 <> 0 AND status = 'running') THEN 'memory' ELSE 'disk' END AS source FROM tasks WHERE id % 3 <> 0 OR id % 4 <> 0",
    "stale_tasks": """SELECT id, status FROM tasks t WHERE status IN ('failed', 'killed') AND NOT EXISTS (FROM chapter_text c WHERE c.project = t.project AND c.number BETWEEN t.from_ch AND t.to_ch AND NOT (c.number % 5 <> 0 OR c.project < 'src4'))""",
    "log_tail": "SELECT id, line_no, line FROM (SELECT user_id AS id, event_id AS line_no, event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_id % 6 <> 0) WHERE k <= 20",
    "neighbour_context": """SELECT session_id, seq, coalesce('【前一分镜·第' || lag(s) OVER w, '（无前一分镜，本镜是开场）') AS previous, coalesce('【后一分镜·第' || lead(s) OVER w, '（无后一分镜，本镜是收尾）') AS next
      FROM (SELECT session_id, seq, seq || '镜】' || type || '「' || label || '」：' || content AS s FROM asks) WINDOW w AS (PARTITION BY session_id ORDER BY seq)""",
    "chapter_bundle": """SELECT t.project, t.number, length(t.text) AS n_chars, k.sentence_count, h.shot_count, c.function, c.summary FROM chapter_text t LEFT JOIN counts k ON k.project = t.project AND k.chapter = t.number
      LEFT JOIN shot_counts h ON h.project = t.project AND h.chapter = t.number LEFT JOIN chapters c ON c.project = t.project AND c.number = t.number""",
    "label_words": f"SELECT DISTINCT project, trim(label) AS word FROM shots WHERE length(trim(label)) BETWEEN 2 AND 8 AND NOT list_contains({STOP}, trim(label))",
    "unigram_counts": "SELECT * FROM ones",
    "ngram_counts": "SELECT * FROM twos",
    "pmi_table": """SELECT t.project, t.gram, t.n, round(log2((t.n / total) / ((a.n / total) * (b.n / total))), 6) AS pmi FROM twos t JOIN ones a ON a.project = t.project AND a.gram = substr(t.gram, 1, 1) JOIN ones b ON b.project = t.project AND b.gram = substr(t.gram, 2, 1)
      JOIN (SELECT project, sum(n)::DOUBLE AS total FROM ones GROUP BY project) k ON k.project = t.project WHERE t.n >= 3""",
    "manifest_diff": "SELECT project, CASE project WHEN 'src6' THEN bool_or(chapter % 5 = 0) WHEN 'src7' THEN bool_or(chapter % 10 = 8) ELSE false END AS rebuild FROM files GROUP BY project",
    "shot_text": "SELECT project, chapter, shot_id, text FROM shot_texts",
    "label_recall": f""", scored AS ({_RANKED_SHOTS}),
      pool AS (SELECT *, row_number() OVER (PARTITION BY type, funcs ORDER BY project, chapter, pos) - 1 AS place, count(*) OVER (PARTITION BY type, funcs) AS size FROM scored WHERE exact),
      seeds AS (SELECT DISTINCT type, funcs, size, type || '|' || array_to_string(funcs, ',') || '|' || size AS seed FROM pool),
      hashed AS (SELECT *, 0 AS i, 2166136261::BIGINT AS h FROM seeds UNION ALL SELECT type, funcs, size, seed, i + 1, (xor(h, unicode(substr(seed, i + 1, 1))::BIGINT) * 16777619) % 4294967296 FROM hashed WHERE i < length(seed)),
      picked AS (SELECT p.* FROM pool p JOIN hashed h ON h.type = p.type AND h.funcs = p.funcs AND h.i = length(h.seed) AND p.place = h.h % h.size),
      every AS (SELECT type, funcs, 0 AS tier, 2.0 AS score, project, chapter, pos, shot_id FROM picked UNION ALL
        SELECT type, funcs, 1, score, project, chapter, pos, shot_id FROM scored s WHERE score > 0 AND NOT EXISTS (FROM picked p WHERE p.type = s.type AND p.funcs = s.funcs AND p.project = s.project AND p.chapter = s.chapter AND p.pos = s.pos))
      SELECT type, array_to_string(funcs, ',') AS funcs, rank, score::DOUBLE AS score, project, chapter, shot_id FROM (SELECT *, row_number() OVER (PARTITION BY type, funcs ORDER BY tier, score DESC, project, chapter, pos) AS rank FROM every) WHERE rank <= 2""",
    "containment_hits": """SELECT DISTINCT q.query_id, q.project, s.project || '|' || s.chapter || '|' || s.shot_id AS key
      FROM (SELECT query_id, project, regexp_replace(content, '[，。！？…、；："“”‘’「」『』—–·〈〉（）《》\\s\\x{00a0}\\x{3000}]', '', 'g') AS q FROM asks) q JOIN shots s ON s.project = q.project AND length(q) >= 2 AND length(label) >= 2 AND (contains(s.label, q.q) OR contains(q.q, s.label))""",
    "vector_topk": """SELECT query_id, project, chapter, shot_id, round(score, 6) AS score FROM (
        SELECT q.vec_id AS query_id, v.project, v.chapter, v.shot_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score,
          row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) DESC, v.project, v.chapter, v.shot_id) AS rank
        FROM vectors q CROSS JOIN vectors v WHERE q.vec_id % 100 = 0) WHERE rank <= 10""",
    "known_books": """SELECT query_id, b AS project, coalesce(b <> 'no such book', true) AS known FROM (SELECT query_id, CASE WHEN seq % 3 = 0 THEN 'no such book' WHEN seq % 3 = 1 THEN project END AS b FROM asks)""",
    "embedding_inputs": "SELECT project, chapter, shot_id, substr(text, 1, 500) AS input FROM shot_texts WHERE text <> ''",
    "vector_plan": _VECTOR_PLAN,
    "vector_refresh": f""", plan AS ({_VECTOR_PLAN}), inputs AS (SELECT project, chapter, shot_id, substr(text, 1, 500) AS input FROM shot_texts WHERE text <> '')
      SELECT project, chapter, shot_id, CASE WHEN rebuild THEN length(input) ELSE -1 END AS n_chars, CASE WHEN rebuild THEN length(input) - length(replace(input, 'e', '')) ELSE -1 END AS n_e FROM inputs JOIN plan USING (project, chapter)""",
    "refreshed_counts": "SELECT * FROM ones UNION ALL SELECT * FROM twos",
    "vector_stats": "SELECT project, sum(shot_count)::BIGINT AS shots, count(*) AS chapters FROM vindex GROUP BY project",
    "layer_sentences": "SELECT project, chapter, pos, sid, seq, struct, text FROM sentences WHERE chapter % 9 <> 0",
    "layer_rejects": "SELECT DISTINCT project, chapter FROM sentences WHERE chapter % 9 = 0",
    "layer_shots": "SELECT project, chapter, pos, shot_id, type, array_to_string(funcs, ',') AS funcs, label, array_to_string(ids, ',') AS sentence_ids FROM shots WHERE chapter % 9 <> 0",
    "manuscript_files": r"""SELECT project, number, CASE WHEN number % 2 = 0 THEN 't' || number WHEN regexp_matches(text, '^#\s+[^\n]') THEN trim(regexp_extract(text, '^#\s+([^\n]+)', 1)) END AS title,
      md5(CASE WHEN number % 2 = 0 THEN '# t' || number || chr(10) || text ELSE text END) AS content_md5, number * 60 AS mtime FROM chapter_text WHERE number < 10000""",
    "split_chapters": "SELECT project, number, '第' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 4, '0') ELSE number::VARCHAR END || '章_t' || number || '.txt' AS file_name, md5(text) AS text_md5 FROM chapter_text",
    "published": "SELECT project, number, CASE WHEN project IN ('src1', 'src2') THEN 2 ELSE 1 END AS version FROM chapter_text WHERE project NOT IN ('src1', 'src2') OR number % 40 < 20",
    "apply_instructions": _APPLIED + """ SELECT project, layer, idx, name, array_to_string(chapters, ',') AS chapters, state, end_ch, applied FROM applied""",
    "rejected_instructions": _APPLIED + """ SELECT g.project, g.layer, g.given, coalesce(a.applied, 0)::BIGINT AS applied, (g.given - coalesce(a.applied, 0))::BIGINT AS rejected
      FROM (SELECT project, layer, count(*) AS given FROM instructions GROUP BY ALL) g LEFT JOIN (SELECT project, layer, sum(applied) AS applied FROM applied GROUP BY ALL) a USING (project, layer)""",
    "rejection_reasons": _APPLIED + """ SELECT * FROM (SELECT i.project, i.layer, i.seq, i.action, i.idx, CASE WHEN action = 'merge' AND (e.born IS NULL OR i.seq <= e.born) THEN 'no_entry'
        WHEN action = 'merge' AND i.entity <> '' AND i.entity <> e.name THEN 'other_name' WHEN action = 'insert' AND i.name IS NULL THEN 'no_name' WHEN action NOT IN ('merge', 'insert') THEN 'unknown_action' END AS reason
      FROM instructions i LEFT JOIN all_entries e ON e.project = i.project AND e.layer = i.layer AND e.idx = i.idx) WHERE reason IS NOT NULL""",
    "markdown_words": r"""SELECT project, number, length(regexp_replace(m, '[\s\x{00a0}\x{3000}]', '', 'g')) AS chars FROM (SELECT project, number,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        CASE WHEN number % 2 = 0 THEN '# t' || number || chr(10) || text ELSE text END,
        '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'), '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
        '(?m)^[^\S\n]*(#{1,6}[^\S\n]+|>[^\S\n]?|[-*+][^\S\n]+|[0-9]+\.[^\S\n]+)', '', 'g'), '(?m)^\s*([-*_]){3,}\s*$', '', 'g'),
        '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '__([^_]+)__', '\1', 'g'), '_([^_]+)_', '\1', 'g'), '~~([^~]+)~~', '\1', 'g') AS m FROM chapter_text)""",
    "safe_names": r"""SELECT session_id, seq, CASE WHEN c = '' THEN '未命名' ELSE c END AS name, regexp_matches(label, '^[一-龥A-Za-z0-9_·《》（）()]+$') AND length(label) <= 50 AS is_corpus_name,
      CASE WHEN session_id * 97 < 1000 THEN lpad((session_id * 97)::VARCHAR, 4, '0') ELSE (session_id * 97)::VARCHAR END AS padded
      FROM (SELECT *, substr(regexp_replace(CASE WHEN seq = 1 THEN '??  ' ELSE content END, '[\\/:*?"<>|，。！？、\s\x{00a0}\x{3000}]', '', 'g'), 1, 12) AS c FROM asks)""",
    "fnv_temperature": """, hashed AS (SELECT session_id, seq, content, 0 AS i, 2166136261::BIGINT AS h FROM asks
        UNION ALL SELECT session_id, seq, content, i + 1, (xor(h, unicode(substr(content, i + 1, 1))::BIGINT) * 16777619) % 4294967296 FROM hashed WHERE i < length(content))
      SELECT session_id, seq, h AS hash, round(0.6::DOUBLE + h / 4294967296.0::DOUBLE * (1.3::DOUBLE - 0.6::DOUBLE), 8) AS temperature FROM hashed WHERE i = length(content)""",
    "sentence_rebuild": """SELECT project, chapter, pos, sid, seq, CASE WHEN seq = 2 THEN '短句' ELSE struct END AS struct, replace(replace(text, chr(92), ''), '"', '') AS text FROM sentences""",
    "tagged_draft": "SELECT session_id, string_agg('【镜' || seq || '｜' || type || '｜' || label || '】' || chr(10) || content, chr(10) || chr(10) ORDER BY seq) AS draft FROM asks GROUP BY session_id",
    "user_blocks": """SELECT session_id, seq, regexp_matches(t, '\\n\\s*\\n') OR regexp_matches(t, '(?m)(^|\\n)\\s*(---|###|【|\\[[0-9]+\\]|[0-9]+[.、])') AS blocks
      FROM (SELECT session_id, seq, CASE session_id % 4 WHEN 0 THEN content || chr(10) || ' ' || chr(10) || content WHEN 1 THEN 'x' || chr(10) || '【a】' || content WHEN 2 THEN '12. ' || content ELSE content END AS t FROM asks)""",
}

_SQL |= recall_sql(_SQL["label_recall"])
ORACLES = {name: f"{BASE}{sql}" for name, sql in _SQL.items()}
