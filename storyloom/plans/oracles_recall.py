"""DuckDB SQL for the lexicon and what is recalled with it: gaps and islands for words, a walk over matches for tokens."""

from __future__ import annotations

from storyloom.functions.enums import CUT_CHARS, LEXICON_STOP_WORDS

_CUTS = "".join(sorted(set(CUT_CHARS)))
_STOPS = "string_split('" + " ".join(LEXICON_STOP_WORDS) + "', ' ')"
_TOKEN_CLEAN = r"regexp_replace({}, '[\[\]（）()【】「」『』、，。！？：；“”‘’\"''—–·〈〉《》\s\x{{00a0}}\x{{3000}}]', ' ', 'g')"
_QUERY_CLEAN = r"regexp_replace(content, '[，。！？…、；：\"“”‘’「」『』—–·〈〉（）《》\s\x{00a0}\x{3000}]', '', 'g')"

PMI_WORDS = f""", bonded AS (
  SELECT t.project, t.gram FROM twos t JOIN ones a ON a.project = t.project AND a.gram = substr(t.gram, 1, 1) JOIN ones b ON b.project = t.project AND b.gram = substr(t.gram, 2, 1)
    JOIN (SELECT project, sum(n)::DOUBLE AS total FROM ones GROUP BY project) k ON k.project = t.project WHERE t.n >= 3 AND log2((t.n / total) / ((a.n / total) * (b.n / total))) >= 2),
numbered AS (SELECT project, row_number() OVER () AS r, clean FROM clean WHERE clean <> ''),
chars AS (SELECT project, r, i, substr(clean, i, 1) AS c FROM (SELECT project, r, clean, unnest(range(1, length(clean) + 1)) AS i FROM numbered)),
linked AS (SELECT *, contains('{_CUTS}', c) AS cuts, lag(c) OVER (PARTITION BY r ORDER BY i) AS p FROM chars),
runs AS (
  SELECT l.*, max(CASE WHEN b.gram IS NULL OR l.cuts OR contains('{_CUTS}', p) THEN i END) OVER (PARTITION BY r ORDER BY i) AS start
  FROM linked l LEFT JOIN bonded b ON b.project = l.project AND b.gram = l.p || l.c),
pieces AS (SELECT project, string_agg(c, '' ORDER BY i) AS word FROM runs WHERE NOT cuts GROUP BY project, r, start, (i - start) // 7),
stat_words AS (SELECT project, word, count(*) AS n FROM pieces GROUP BY ALL)"""

LEXICON = f"""{PMI_WORDS},
lexicon AS (
  SELECT project, word, bool_or(l) AS from_label, max(n) AS freq FROM (
    SELECT project, trim(label) AS word, true AS l, 0 AS n FROM shots WHERE length(trim(label)) BETWEEN 2 AND 8 AND NOT list_contains({_STOPS}, trim(label))
    UNION ALL SELECT project, word, false, n FROM stat_words WHERE length(word) BETWEEN 2 AND 4 AND NOT list_contains({_STOPS}, word) AND n >= 3) GROUP BY ALL)"""

#: Tokens of ``sources`` (kind, id, project, text): of all matches at a place the longest, then the first match at or after its end, and so on.
TOKENS = """,
spots AS (
  SELECT s.kind, s.id, s.project, i, max(size) AS size FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM sources) s, (SELECT DISTINCT project, length(word) AS size FROM lexicon) z
  WHERE z.project = s.project AND i + size - 1 <= length(text) AND EXISTS (FROM lexicon w WHERE w.project = s.project AND w.word = substr(s.text, i, size)) GROUP BY ALL),
steps AS (SELECT a.*, b.i AS next FROM spots a ASOF LEFT JOIN spots b ON a.kind = b.kind AND a.id = b.id AND a.i + a.size <= b.i),
walk AS (
  SELECT kind, id, project, i, size, next FROM steps QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY i) = 1
  UNION ALL SELECT s.kind, s.id, s.project, s.i, s.size, s.next FROM walk w JOIN steps s ON s.kind = w.kind AND s.id = w.id AND s.i = w.next),
tokens AS (SELECT w.kind, w.id, w.project, substr(s.text, w.i, w.size) AS token, count(*) AS n FROM walk w JOIN sources s ON s.kind = w.kind AND s.id = w.id GROUP BY ALL)"""

_KEY = "project || '|' || chapter || '|' || shot_id"
_TEXTS = f"SELECT 't' AS kind, {_KEY} AS id, project, {_TOKEN_CLEAN.format('text')} AS text FROM shot_texts"

TOKEN_POSTINGS = f"""{LEXICON},
sources AS ({_TEXTS}){TOKENS}
SELECT project, id AS key, token, n FROM tokens"""

OVERLAP = f"""{LEXICON},
queries AS (SELECT * FROM (SELECT query_id, project, {_QUERY_CLEAN} AS q FROM asks) WHERE length(q) >= 2),
sources AS ({_TEXTS}
  UNION ALL SELECT 'q', query_id, project, q FROM queries
  UNION ALL SELECT 'l', {_KEY}, project, {_TOKEN_CLEAN.format("label")} FROM shots WHERE length(label) >= 2){TOKENS},
shared AS (SELECT t.kind, q.id AS query_id, q.project, t.id AS key, sum(t.n) AS n FROM tokens q JOIN tokens t ON q.kind = 'q' AND t.kind <> 'q' AND t.project = q.project AND t.token = q.token GROUP BY ALL),
held AS (SELECT q.query_id, q.project, {_KEY.replace("project", "s.project").replace("chapter", "s.chapter").replace("shot_id", "s.shot_id")} AS key, 1 AS n FROM queries q JOIN shots s ON s.project = q.project AND length(label) >= 2 AND (contains(s.label, q.q) OR contains(q.q, s.label))),
overlap_parts AS (
  SELECT query_id, project, key, max(n) AS n FROM (SELECT query_id, project, key, n FROM shared WHERE kind = 'l' UNION ALL FROM held) GROUP BY ALL
  UNION ALL SELECT s.query_id, s.project, s.key, s.n FROM shared s JOIN queries q ON q.query_id = s.query_id JOIN shot_texts t ON t.project || '|' || t.chapter || '|' || t.shot_id = s.key
    WHERE s.kind = 't' AND length(t.text) >= length(q.q) AND len(list_filter(list_distinct(string_split(q.q, '')), lambda c: contains(t.text, c))) >= 2),
overlap AS (SELECT query_id, project, key, sum(n)::BIGINT AS n FROM overlap_parts GROUP BY ALL)"""

TOKEN_HITS = f"""{OVERLAP},
tops AS (
  SELECT o.*, s.chapter, s.pos, s.shot_id, row_number() OVER (PARTITION BY o.query_id ORDER BY o.n DESC, o.project, s.chapter, s.pos) = 1 AS top
  FROM overlap o JOIN shots s ON s.project || '|' || s.chapter || '|' || s.shot_id = o.key),
token_hits AS (
  SELECT query_id, rank, project, chapter, shot_id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY top DESC, md5('pick|' || query_id || '|' || key)) AS rank FROM tops) WHERE rank <= 2)"""


def merged(label_recall: str) -> str:
    """The three channels of each request, merged; ``label_recall`` is the SQL of that query."""
    head, body = label_recall.rsplit("\n      SELECT type,", 1)
    return f"""{TOKEN_HITS}{head},
label_top AS (SELECT type,{body}),
label_hits AS (SELECT a.query_id, l.rank, l.score, l.project, l.chapter, l.shot_id FROM asks a JOIN label_top l ON l.type = a.type AND l.funcs = array_to_string(list_sort(a.funcs), ',')),
scores AS (
  SELECT a.query_id, 'src' || (v.vec_id % 20) AS project, (v.vec_id + 1)::INT AS chapter, '1' AS shot_id, list_dot_product(q.e, v.e) / greatest(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)), 1e-9) AS score
  FROM asks a JOIN vectors q ON q.vec_id = (a.session_id * 7 + a.seq) % (SELECT count(*) FROM vectors) CROSS JOIN vectors v),
vec_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, project, chapter, shot_id) AS rank FROM scores) WHERE rank <= 2),
channels AS (
  SELECT query_id, 'label' AS channel, 0 AS turn, rank, score, project, chapter, shot_id FROM label_hits
  UNION ALL SELECT query_id, 'token', 1, rank, NULL, project, chapter, shot_id FROM token_hits
  UNION ALL SELECT query_id, 'vec', 2, rank, score, project, chapter, shot_id FROM vec_hits),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, rank) AS place
  FROM (SELECT * FROM channels QUALIFY row_number() OVER (PARTITION BY query_id, project, chapter, shot_id ORDER BY turn, rank) = 1))"""


#: A hit with what is shown of it; hits without text go.
DESCRIBED = """,
untrimmed AS (SELECT s.project, s.chapter, s.shot_id, string_agg(t.text, '' ORDER BY t.seq) AS text FROM shots s JOIN sentences t ON t.project = s.project AND t.chapter = s.chapter AND t.seq BETWEEN s.a AND s.b GROUP BY ALL),
refs AS (SELECT p.query_id, p.place, p.channel, p.project, p.chapter, p.shot_id, s.type, s.funcs, s.label, t.text FROM placed p JOIN shots s USING (project, chapter, shot_id) JOIN untrimmed t USING (project, chapter, shot_id) WHERE t.text <> '')"""


def recall_sql(label_recall: str) -> dict[str, str]:
    every = merged(label_recall)
    padded = "CASE WHEN chapter < 1000 THEN lpad(chapter::VARCHAR, 4, '0') ELSE chapter::VARCHAR END"
    return {
        "pmi_words": f"{PMI_WORDS}\nSELECT * FROM stat_words",
        "lexicon_words": f"{LEXICON}\nSELECT * FROM lexicon",
        "lexicon_refresh": f"{LEXICON}\nSELECT * FROM lexicon",
        "lexicon_stats": f"{LEXICON}\nSELECT project, count(*) AS entities, count(*) FILTER (WHERE from_label) AS label_words, count(*) FILTER (WHERE freq > 0) AS frequent_words FROM lexicon GROUP BY project",
        "token_postings": TOKEN_POSTINGS,
        "token_overlap": f"{OVERLAP}\nSELECT * FROM overlap",
        "token_recall": f"{TOKEN_HITS}\nSELECT query_id, 'token' AS channel, rank, NULL::DOUBLE AS score, project, chapter, shot_id, n FROM token_hits",
        "recall_merge": f"{every}\nSELECT query_id, place, channel, round(score, 6) AS score, project, chapter, shot_id FROM placed",
        "context_block": f"""{every}{DESCRIBED}
SELECT query_id, string_agg('[RAG-' || place || '] (' || type || '|' || array_to_string(funcs, ',') || ') ' || project || '·第' || {padded} || '章:镜' || shot_id || '「' || label || '」' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS block FROM refs GROUP BY query_id""",
        "reference_lists": f"""{every}{DESCRIBED}
SELECT a.query_id, coalesce(r.refs, '（无参考）') AS refs FROM (SELECT DISTINCT query_id FROM asks) a LEFT JOIN (
  SELECT query_id, string_agg(place || '. [' || channel || '] 第' || chapter || '章 分镜' || shot_id || '（' || type || '/' || array_to_string(funcs, '、') || '「' || label || '」）：' || text, chr(10) ORDER BY place) AS refs FROM refs GROUP BY query_id) r USING (query_id)""",
        "style_samples": f"""{every}{DESCRIBED}
SELECT session_id, substr(sample, 1, 3000) AS sample FROM (
  SELECT split_part(query_id, '-', 1) AS session_id, string_agg('- ' || text, chr(10) ORDER BY split_part(query_id, '-', 2)::INT, place) AS sample FROM refs GROUP BY ALL) WHERE length(trim(sample)) > 20""",
    }
