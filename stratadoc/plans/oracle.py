"""The registered queries once more, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from stratadoc import fixed_values as fv
from stratadoc.plans.catalog import LONGEST_TEXT, RATE


def _text(value: str) -> str:
    """SQL expression of a text, line breaks written as chr(10)."""
    quoted = value.replace("'", "''").split("\n")
    return "('" + "' || chr(10) || '".join(quoted) + "')"


def _filled(template: str, **values: str) -> str:
    """SQL expression of a template whose ``{name}`` places are SQL expressions."""
    out = [template]
    for name, expression in values.items():
        out = [p for part in out for p in _pieces(part, name, expression)]
    return " || ".join(_text(p) if isinstance(p, str) else p[0] for p in out if p != "")


def _pieces(part, name, expression):
    if not isinstance(part, str):
        return [part]
    pieces = part.split("{" + name + "}")
    out = [pieces[0]]
    for piece in pieces[1:]:
        out += [(expression,), piece]
    return out


WS = "(" + " || ".join(f"chr({ord(c)})" for c in fv.WHITESPACE) + ")"


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _embedded(name: str, source: str, key: str, text: str) -> str:
    """CTEs ``<name>`` of (key, v): dense unit vectors of hashed token counts."""
    return f"""
{name}_t AS (SELECT {key} AS k, unnest({_tokens(text)}) AS t FROM {source}),
{name}_c AS (SELECT k, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {fv.EMBED_DIM} AS b, count(*) AS c
  FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM {name}_c GROUP BY k),
{name}_g AS (SELECT k, r.b, n FROM {name}_n, (SELECT unnest(range({fv.EMBED_DIM})) AS b) r),
{name} AS (SELECT g.k, list(CASE WHEN c.c IS NULL THEN 0.0::DOUBLE ELSE c.c::DOUBLE / g.n END ORDER BY g.b) AS v
  FROM {name}_g g LEFT JOIN {name}_c c ON c.k = g.k AND c.b = g.b GROUP BY g.k)"""


_UNIT = """
unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS v
  FROM (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n
    FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)))"""


def _topk(k: int, condition: str) -> str:
    return f"""{_UNIT},
pairs AS (SELECT q.vec_id AS question_id, i.vec_id, floor(list_inner_product(q.v, i.v) * 1e9 + 0.5) / 1e9 AS score
  FROM unit q JOIN unit i ON {condition}),
hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank
  FROM pairs QUALIFY rank <= {k})"""


_TURNS = """
turns AS (SELECT conv_id, turn, 's' || conv_id AS session_id, conv_id || '-' || turn AS question_id,
  role, text AS content FROM conversations),
questions AS (SELECT question_id, conv_id, turn, session_id, content AS text FROM turns WHERE role = 'user'),
eq AS (SELECT question_id, conv_id, text || ' Customer#' || lpad(conv_id::VARCHAR, 9, '0') || ' NATION_' || (conv_id % 25) AS text
  FROM questions),
answered AS (SELECT q.question_id, q.conv_id, q.turn, q.session_id, q.content AS question, a.content AS answer
  FROM turns q JOIN turns a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""

_GRAPH = """
raw_nodes AS (
  SELECT n_nationkey::BIGINT AS seq, 0 AS pos, n_name AS name, 'Location' AS type FROM nation
  UNION ALL SELECT n_nationkey, 1, r_name, 'Location' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 1000000000000 + s_suppkey, 0, s_name, 'Organization' FROM supplier WHERE s_acctbal >= 0
  UNION ALL SELECT 2000000000000 + c_custkey, 0, c_name,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Company' ELSE 'Organization' END FROM customer
  UNION ALL SELECT 3000000000000 + l_orderkey * 8 + l_linenumber, 0, p_name || '#' || p_partkey,
    CASE WHEN l_returnflag = 'R' THEN 'Concept' ELSE 'Product' END FROM lineitem JOIN part ON l_partkey = p_partkey),
nodes AS (SELECT name, type FROM raw_nodes
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC, pos DESC) = 1),
raw_edges AS (
  SELECT n_name AS source, r_name AS target, 'PART_OF' AS type FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT s_name, n_name, 'LOCATED_IN' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
  UNION SELECT c_name, n_name, 'LOCATED_IN' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT p_name || '#' || p_partkey, s_name, 'CREATED_BY' FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey),
edges AS (SELECT * FROM raw_edges WHERE source IN (SELECT name FROM nodes) AND target IN (SELECT name FROM nodes)),
either AS (SELECT source, target, type FROM edges
  UNION ALL SELECT target, source, type FROM edges WHERE source <> target)"""


def _bm25(source: str, key: str, text: str) -> str:
    """CTE ``scored`` of (key, name, score): BM25 of every node name sharing a token."""
    return f"""
nt AS (SELECT name, {_tokens('name')} AS ts FROM nodes),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM nt),
tf AS (SELECT name, t, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT name, unnest(ts) AS t, len(ts) AS dl FROM nt) GROUP BY name, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
qt AS (SELECT DISTINCT {key} AS k, unnest({_tokens(text)}) AS t FROM {source}),
scored AS (SELECT k, name, floor(s * 1e6 + 0.5) / 1e6 AS score FROM (
  SELECT qt.k, tf.name, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({fv.BM25_K1} + 1)
    / (tf + {fv.BM25_K1} * (1 - {fv.BM25_B} + {fv.BM25_B} * dl / mean))) AS s
  FROM qt JOIN tf USING (t) JOIN df USING (t), stats GROUP BY qt.k, tf.name))"""


_DIRECTED = f"""
directed AS (SELECT k AS question_id, score, source, type AS rel, target,
  row_number() OVER (PARTITION BY k ORDER BY score DESC, source, type, target) AS rank
  FROM scored JOIN edges ON edges.source = scored.name QUALIFY rank <= {fv.GRAPH_CONTEXT_LIMIT})"""

_ENTITIES = """
entities AS (SELECT question_id, e.pos, e.entity FROM (
  SELECT question_id, length(text) % 5 AS kind,
    [{'pos': 0, 'entity': 'Customer#' || lpad(conv_id::VARCHAR, 9, '0')},
     {'pos': 1, 'entity': 'NATION_' || (conv_id % 25)}] AS es FROM questions), unnest(es) AS u(e) WHERE kind > 1)"""

_CHUNKS = f"""
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index,
    substr(text, CAST(i + 1 AS BIGINT), {fv.CHUNK_SIZE}) AS text, source || '_' || doc_id || '.txt' AS filename
  FROM (SELECT *, unnest(range(0, greatest(length(text) - {fv.CHUNK_OVERLAP}, 1), {fv.CHUNK_SIZE - fv.CHUNK_OVERLAP})) AS i
    FROM documents) WHERE length(text) > 0)"""



def _recursive(source: str, key: str, separators: tuple[str, ...] = fv.SEPARATORS) -> str:
    """CTEs ending in ``rchunks`` (key, chunk_index, text) of ``source`` (key, text), split by separators.

    Each level cuts its texts into pieces; pieces as long as a chunk are the next level's texts. One recursion then
    walks all levels' pieces at once: it carries the first piece of the open chunk and gives the ranges that close.
    """
    size, overlap = fv.CHUNK_SIZE, fv.CHUNK_OVERLAP
    parts, levels = [f"rtext0 AS (SELECT {key} AS k, CAST([] AS INTEGER[]) AS path, text FROM {source} WHERE text IS NOT NULL)"], []
    for i, separator in enumerate(separators):
        if separator:
            sign = _text(separator)
            cut = f"list_filter(list_transform(string_split(text, {sign}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {sign} || p END), lambda p: p <> '')"
        else:
            cut = "regexp_extract_all(text, '(?s).')"
        parts.append(f"""rpiece{i} AS MATERIALIZED (SELECT k, path, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece
  FROM (SELECT k, path, {cut} AS ps FROM rtext{i}))""")
        parts.append(f"rtext{i + 1} AS (SELECT k, list_append(path, 2 * i + 1) AS path, piece AS text FROM rpiece{i} WHERE length(piece) >= {size})")
        levels.append(f"SELECT * FROM rpiece{i}")
    return ",\n".join(parts) + f""",
rsum AS (SELECT *, length(piece) AS n, length(piece) >= {size} AS long,
    coalesce(sum(length(piece)) OVER (PARTITION BY k, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM ({" UNION ALL ".join(levels)})),
rlist AS (SELECT k, path, list(c ORDER BY i) AS cs, max(i) AS last FROM rsum GROUP BY k, path),
rall AS MATERIALIZED (SELECT s.*, last,
    s.i - len(list_filter(cs[1:s.i], lambda x: x >= s.c - least({overlap}, {size} - s.n))) + 1 AS jump
  FROM rsum s JOIN rlist l ON s.k = l.k AND s.path = l.path),
rwalk AS (
  SELECT k, path, i, last, CASE WHEN long THEN 2 ELSE 1 END AS b, CAST(NULL AS BIGINT) AS e, c, CASE WHEN long THEN c + n ELSE c END AS cb
  FROM rall WHERE i = 1
  UNION ALL
  SELECT w.k, w.path, a.i, a.last,
    CASE WHEN a.long THEN a.i + 1 WHEN a.c - w.cb + a.n > {size} AND a.i > w.b THEN greatest(w.b, a.jump) ELSE w.b END,
    CASE WHEN a.i > w.b AND (a.long OR a.c - w.cb + a.n > {size}) THEN w.b END, a.c,
    CASE WHEN a.long THEN a.c + a.n WHEN a.c - w.cb + a.n > {size} AND a.i > w.b THEN (SELECT max(z.c) FROM rall z
      WHERE z.k = w.k AND z.path = w.path AND z.i = greatest(w.b, a.jump)) ELSE w.cb END
  FROM rwalk w JOIN rall a ON a.k = w.k AND a.path = w.path AND a.i = w.i + 1),
rclosed AS (SELECT k, path, e AS b, i AS t FROM rwalk WHERE e IS NOT NULL
  UNION ALL SELECT k, path, b, last + 1 FROM rwalk WHERE i = last AND b <= last),
rjoined AS (SELECT c.k, list_append(c.path, 2 * c.t) AS place, trim(string_agg(a.piece, '' ORDER BY a.i), {WS}) AS text
  FROM rclosed c JOIN rall a ON a.k = c.k AND a.path = c.path AND a.i >= c.b AND a.i < c.t GROUP BY c.k, c.path, c.t),
rchunks AS (SELECT k AS {key}, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS chunk_index, text FROM rjoined WHERE text <> '')"""


_HYBRID = f"""
cp AS (SELECT doc_id || '-' || chunk_index AS point_id, text, filename FROM chunks),
{_embedded('cv', 'cp', 'point_id', 'text')},
{_embedded('qv', 'eq', 'question_id', 'text')},
vhits AS (SELECT qv.k AS question_id, cv.k AS point_id,
  row_number() OVER (PARTITION BY qv.k ORDER BY floor(list_inner_product(qv.v, cv.v) * 1e9 + 0.5) DESC, cv.k) AS rank
  FROM qv, cv QUALIFY rank <= {fv.SEARCH_LIMIT}),
found AS (SELECT question_id, 0 AS branch, rank, text || ' [Source: ' || filename || ']' AS text
    FROM vhits JOIN cp USING (point_id)
  UNION ALL SELECT question_id, 1, rank, source || ' ' || rel || ' ' || target FROM directed),
hybrid AS (SELECT question_id, branch, rank, text FROM found
  QUALIFY row_number() OVER (PARTITION BY question_id, text ORDER BY branch, rank) = 1)"""

_NEAREST = f"""
nearest AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, point_id) AS rank FROM (
  SELECT qv.k AS question_id, cv.k AS point_id, floor(list_inner_product(qv.v, cv.v) * 1e9 + 0.5) / 1e9 AS score FROM qv, cv)
  QUALIFY rank <= {fv.SEARCH_LIMIT})"""

_HYBRID_ALL = f"WITH {_TURNS}, {_GRAPH}, {_CHUNKS}, {_bm25('eq', 'question_id', 'text')}, {_DIRECTED}, {_HYBRID}"

_PLANS = """
plans AS (SELECT question_id, text AS question, length(text) % 6 AS kind, text AS head FROM questions),
normal AS (SELECT question_id,
  CASE WHEN kind IN (0, 1, 2) THEN head ELSE question END AS current_query,
  CASE kind WHEN 0 THEN 'look it up' WHEN 1 THEN 'Planning completed.' WHEN 2 THEN 'Planning completed.'
    WHEN 3 THEN 'Planning completed.' ELSE 'Error in planning, defaulting to retrieval.' END AS plan_steps,
  CASE kind WHEN 1 THEN 'graph_search' WHEN 2 THEN 'vector_search' ELSE '' END AS tool_choice,
  CASE kind WHEN 1 THEN question_id WHEN 2 THEN head ELSE '' END AS tool_input FROM plans)"""

_STATES = f"""
recent AS (SELECT *, CASE WHEN turn % 3 = 1 THEN 'Tool Output:  ' || content || chr(10) ELSE content END AS marked
  FROM turns),
states AS (SELECT session_id, conv_id,
    string_agg(role || ': ' || marked, chr(10) ORDER BY turn) AS lines,
    arg_max(content, turn) FILTER (turn % 3 = 1) AS last_output,
    'fact ' || session_id || chr(10) || chr(10) || 'second fact' AS context,
    'What of ' || session_id || '?' AS current_query
  FROM recent GROUP BY session_id, conv_id),
sources AS (SELECT session_id, current_query, CASE WHEN conv_id % 2 = 0 THEN coalesce(trim(last_output, {WS}), '') ELSE '' END AS tool_output,
  context FROM states),
sourced AS (SELECT session_id, current_query, tool_output,
  CASE WHEN tool_output <> '' THEN 'tool output' ELSE 'retrieved context' END AS source_label,
  CASE WHEN tool_output <> '' THEN tool_output ELSE context END AS source_content FROM sources)"""

_ENTITY_CALLS = "".join(
    f", '{name}', '{char}')"
    for name, char in (
        ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    )
)


def _unescaped(expression: str) -> str:
    return "replace(" * 7 + expression + _ENTITY_CALLS


def _cleaned(expression: str, pattern: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split_regex({expression}, '{pattern}'), "
        f"lambda p: trim(p, {WS})), lambda p: p <> ''), chr(10))"
    )


_NO_COMMENT = "regexp_replace({0}, '(?s)<!--.*?-->', chr(10), 'g')"
_STRIPPED = (
    "regexp_replace("
    + _NO_COMMENT.format(
        "regexp_replace(html, '(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>', chr(10), 'g')"
    )
    + ", '(?s)<[^>]*>', chr(10), 'g')"
)
_ARTICLE = "regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)"
_RAW_TITLE = "regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"
_PAGES = f"""
parsed AS (SELECT page_id, url, {_unescaped(f"trim(split_part({_unescaped(_RAW_TITLE)}, '|', 1), {WS})")} AS title,
  {_ARTICLE} AS article FROM pages),
plain AS (SELECT page_id, url, title,
  {_cleaned(_unescaped("regexp_replace(" + _NO_COMMENT.format("article").replace("chr(10)", "chr(1)") + ", '(?s)<[^>]*>', chr(1), 'g')"), chr(92) + "x01")} AS body FROM parsed)"""
_TXT = "title || chr(10) || repeat('=', length(title)) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || body || chr(10)"

_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _slug(path: str) -> str:
    joined = f"array_to_string(list_filter(string_split({path}, '/'), lambda p: p <> '' AND p <> 'docs'), '_')"
    return f"coalesce(nullif(substr(trim(regexp_replace({joined}, '[^a-zA-Z0-9._-]+', '_', 'g'), '_'), 1, 120), ''), 'home')"


def _numbered(source: str, path: str) -> str:
    return f"""
slugs AS (SELECT seq, url, {_slug(path)} AS base FROM {source}),
named AS (SELECT seq, url, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY seq) > 1
  THEN '_' || seq ELSE '' END AS slug FROM slugs)"""


_BUCKETS = f"""
bucketed AS (SELECT page_id AS pos, url, CASE WHEN starts_with({_PATH}, '/en/') THEN 'en' WHEN starts_with({_PATH}, '/fr/') THEN 'fr'
  WHEN starts_with({_PATH}, '/de/') THEN 'de' WHEN starts_with({_PATH}, '/es/') THEN 'es' ELSE 'other' END AS bucket FROM pages)"""

_PICKED = f"""{_BUCKETS},
quotas(bucket, o, quota) AS (VALUES ('en', 0, 18), ('fr', 1, 16), ('de', 2, 6), ('es', 3, 5)),
quota_rows AS (SELECT url, bucket, o, row_number() OVER (PARTITION BY bucket ORDER BY url) AS i, quota
  FROM bucketed JOIN quotas USING (bucket) QUALIFY i <= quota),
picked AS (SELECT row_number() OVER (ORDER BY part, o, i) AS place, url, bucket FROM (
  SELECT 1 AS part, o, i, url, bucket FROM quota_rows
  UNION ALL SELECT 2, 0, pos, url, bucket FROM bucketed WHERE url NOT IN (SELECT url FROM quota_rows))
  QUALIFY place <= 70)"""


def _windows(key: str, seconds: int) -> str:
    """CTE ``marked`` of (event_id, key, ts, window_start), following windows event by event."""
    return f"""RECURSIVE ev AS (SELECT event_id, {key} AS key, epoch_us(ts) AS ts,
  row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
marked AS (SELECT event_id, key, ts, i, ts AS window_start FROM ev WHERE i = 1
  UNION ALL SELECT e.event_id, e.key, e.ts, e.i,
    CASE WHEN e.ts >= m.window_start + {seconds}::BIGINT * 1000000 THEN e.ts ELSE m.window_start END
  FROM marked m JOIN ev e ON e.key = m.key AND e.i = m.i + 1)"""


def _limited(key: str, limit: int, seconds: int) -> str:
    return f"""WITH {_windows(key, seconds)}
SELECT event_id, key AS {key}, row_number() OVER (PARTITION BY key, window_start ORDER BY ts, event_id) <= {limit} AS allowed
FROM marked"""


_GAZ = f"""
gaz AS (SELECT DISTINCT t AS token FROM (SELECT unnest({_tokens('text')}) AS t FROM benchmark)),
words AS (SELECT doc_id, chunk_index, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos
  FROM (SELECT doc_id, chunk_index, {_tokens('text')} AS ts FROM chunks)),
firsts AS (SELECT doc_id, chunk_index, token, min(pos) AS pos FROM words JOIN gaz USING (token) GROUP BY ALL),
links AS (SELECT token AS source, lead(token) OVER (PARTITION BY doc_id, chunk_index ORDER BY pos) AS target FROM firsts)"""

_PAGE_TEXTS = f"""
pt AS (SELECT page_id, CASE WHEN {_PATH} = '' THEN 'object_' || page_id ELSE regexp_extract({_PATH}, '([^/]*)$', 1) END AS filename,
  {_cleaned(_unescaped(_STRIPPED), chr(92) + 'n|  ')} AS text FROM pages)"""
_PAGE_POINTS = f"""{_PAGE_TEXTS},
{_recursive('pt', 'page_id')},
cp AS (SELECT DISTINCT md5(filename || chr(1) || chunk_index || chr(1) || md5(c.text)) AS point_id, filename, c.text AS text
  FROM rchunks c JOIN pt USING (page_id)),
{_embedded('cv', 'cp', 'point_id', 'text')}"""


def _near(name: str, questions: str, k: int) -> str:
    """CTE ``name`` (question_id, point_id, rank) of the points nearest to an embedded table."""
    return f"""{name} AS (SELECT q.k AS question_id, cv.k AS point_id,
  row_number() OVER (PARTITION BY q.k ORDER BY floor(list_inner_product(q.v, cv.v) * 1e9 + 0.5) DESC, cv.k) AS rank
  FROM {questions} q, cv QUALIFY rank <= {k})"""


def _scores(name: str, source: str, text: str) -> str:
    """CTE ``name`` like ``scored``, for a second table of questions over the same names."""
    own = _bm25(source, "question_id", text).split("qt AS (")[1]
    return f"{name}_t AS (" + own.replace("scored AS", f"{name} AS").replace("qt.k", f"{name}_t.k").replace("FROM qt", f"FROM {name}_t")


_ANSWER = f"""WITH RECURSIVE {_TURNS}, {_GRAPH}, {_PAGE_POINTS},
{_embedded('av', 'answered', 'question_id', 'question')}, {_embedded('ev', 'eq', 'question_id', 'text')},
known AS (SELECT DISTINCT ev.k AS question_id FROM ev, av
  WHERE floor(list_inner_product(ev.v, av.v) * 1e9 + 0.5) / 1e9 >= {fv.CACHE_THRESHOLD}),
missed AS (SELECT question_id, text FROM eq WHERE question_id NOT IN (SELECT question_id FROM known)),
{_PLANS.strip().replace('FROM questions)', 'FROM missed)')},
routed AS (SELECT *, CASE WHEN tool_choice <> '' THEN 'tool' ELSE 'retriever' END AS route FROM normal),
asked AS (SELECT question_id, current_query AS text FROM routed WHERE route = 'retriever'),
{_embedded('qv', 'asked', 'question_id', 'text')}, {_near('vhits', 'qv', fv.SEARCH_LIMIT)},
{_bm25('asked', 'question_id', 'text')}, {_DIRECTED.strip()},
found AS (SELECT question_id, 0 AS branch, rank, text || ' [Source: ' || filename || ']' AS text FROM vhits JOIN cp USING (point_id)
  UNION ALL SELECT question_id, 1, rank, source || ' ' || rel || ' ' || target FROM directed),
contexts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY question_id, text ORDER BY branch, rank) = 1),
documents_of AS (SELECT question_id, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY branch, rank, text) AS context
  FROM contexts GROUP BY question_id),
called AS (SELECT question_id, tool_choice, CASE WHEN tool_input <> '' THEN tool_input ELSE current_query END AS tool_text
  FROM routed WHERE route = 'tool'),
searched AS (SELECT * FROM called WHERE tool_choice = 'vector_search'),
{_embedded('sv', 'searched', 'question_id', 'tool_text')}, {_near('shits', 'sv', fv.TOOL_SEARCH_LIMIT)},
passages AS (SELECT question_id, string_agg('- Content: ' || substr(text, 1, {fv.EXCERPT_CHARS}) || '... [Source: ' || filename || ', Page: 0]' || chr(10), ''
  ORDER BY rank) AS result FROM shits JOIN cp USING (point_id) GROUP BY question_id),
looked AS (SELECT * FROM called WHERE tool_choice = 'graph_search'), {_scores('gs', 'looked', 'tool_text')},
linked AS (SELECT k AS question_id, row_number() OVER (PARTITION BY k ORDER BY score DESC, source, type, target) AS rank, source, type AS rel, target
  FROM gs JOIN either ON source = name QUALIFY rank <= {fv.GRAPH_TOOL_LIMIT}),
facts AS (SELECT question_id, '[' || string_agg('{{"source":' || to_json(source)::VARCHAR || ',"rel":' || to_json(rel)::VARCHAR || ',"target":'
  || to_json(target)::VARCHAR || '}}', ',' ORDER BY rank) || ']' AS result FROM linked GROUP BY question_id),
outputs AS (SELECT question_id, trim(CASE WHEN tool_choice = 'vector_search' THEN coalesce(p.result, {_text(fv.NO_DOCUMENTS)})
    ELSE coalesce(f.result, {_text(fv.NO_CONNECTIONS)}) END, {WS}) AS output
  FROM called LEFT JOIN passages p USING (question_id) LEFT JOIN facts f USING (question_id)),
answers AS (SELECT question_id, route, current_query, coalesce(n, 0)::INTEGER AS n_documents,
    CASE WHEN coalesce(output, '') <> '' THEN {_text(fv.LABEL_TOOL)} ELSE {_text(fv.LABEL_CONTEXT)} END AS source_label,
    CASE WHEN coalesce(output, '') <> '' THEN output ELSE coalesce(context, '') END AS source_content
  FROM routed LEFT JOIN documents_of USING (question_id) LEFT JOIN outputs USING (question_id))
SELECT question_id, route, n_documents,
  {_filled(fv.ANSWER_PROMPT, label='source_label', content='source_content', question='current_query')} AS prompt FROM answers"""

_EVENTS = f"""WITH {_TURNS}, parts AS (
  SELECT session_id, turn AS seq, 0 AS part, CASE WHEN role = 'system'
    THEN '{{"type":"error","content":"{fv.INTERNAL_ERROR}"}}'
    ELSE '{{"type":"status","node":"' || n || '","session_id":"' || session_id || '","info":"Completed step: ' || n || '"}}' END AS line
  FROM (SELECT *, CASE WHEN role = 'assistant' THEN 'responder' ELSE 'planner' END AS n FROM turns)
  UNION ALL SELECT session_id, turn, 1, '{{"type":"answer","content":' || to_json(content)::VARCHAR || ',"session_id":"' || session_id || '"}}'
  FROM turns WHERE role = 'assistant')"""

ORACLE: dict[str, str] = {
    "chunk_recursive": f"WITH RECURSIVE {_recursive('documents', 'doc_id')} SELECT doc_id, chunk_index, text FROM rchunks",
    "page_contexts": f"""WITH RECURSIVE {_TURNS}, {_PAGE_POINTS}, {_embedded('qv', 'questions', 'question_id', 'text')}, {_NEAREST}
SELECT question_id, rank, score, text || ' [Source: ' || filename || ']' AS text FROM nearest JOIN cp USING (point_id)""",
    "answer_prompts": _ANSWER,
    "hybrid_graph_down": f"{_HYBRID_ALL} SELECT question_id, branch, rank, text, 1 AS dead_letters FROM found WHERE branch = 0 "
    "QUALIFY row_number() OVER (PARTITION BY question_id, text ORDER BY rank) = 1",
    "chunk_config": f"""WITH RECURSIVE {_recursive('documents', 'doc_id', fv.CONFIG_SEPARATORS)}
SELECT doc_id, chunk_index, text FROM rchunks""",
    "embed_failures": f"""SELECT doc_id, CASE WHEN length(text) <= {LONGEST_TEXT} THEN {fv.EMBED_DIM} ELSE 0 END AS dim,
  CASE WHEN length(text) > {LONGEST_TEXT} THEN 'no embedding' END AS error FROM documents""",
    "parse_failures": """SELECT 1000000000000 + s_suppkey AS doc_id, 'document could not be parsed' AS error FROM supplier WHERE s_acctbal < 0""",
    "graph_store_nodes": f"WITH {_GRAPH} SELECT name, type FROM nodes",
    "graph_store_edges": f"WITH {_GRAPH} SELECT source, target, type FROM edges",
    "page_files_written": "SELECT page_id || '.html' AS name, strlen(html) AS length, md5(html) AS md5 FROM pages",
    "notified_pages": f"""WITH RECURSIVE {_PAGE_TEXTS}, {_recursive('pt', 'page_id')}
SELECT md5(page_id || '.html' || chr(1) || chunk_index || chr(1) || md5(text)) AS point_id, page_id || '.html' AS filename, text, 0 AS page FROM rchunks
UNION ALL SELECT '', 'gone.html', '', -1""",
    "ingest_counts": f"""WITH RECURSIVE {_PAGE_TEXTS}, {_recursive('pt', 'page_id')}
SELECT (SELECT count(*) FROM pages) AS files, count(DISTINCT page_id) AS documents, count(*) AS chunks,
  count(DISTINCT page_id || ' ' || chunk_index || ' ' || text) AS points, 0 AS empty_batches FROM rchunks""",
    "element_points": f"""WITH RECURSIVE et AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
{_recursive('et', 'conv_id')}
SELECT md5('conversation_' || conv_id || '.pdf' || chr(1) || chunk_index || chr(1) || md5(text)) AS point_id,
  'conversation_' || conv_id || '.pdf' AS filename, text FROM rchunks""",
    "vector_topk": f"WITH {_topk(5, 'q.vec_id <> i.vec_id')} SELECT question_id, vec_id, rank, score FROM hits",
    "vector_topk_filtered": f"WITH {_topk(5, 'q.vec_id <> i.vec_id AND q.label = i.label')} "
    "SELECT question_id, vec_id, rank, score FROM hits",
    "vector_topk_cells": f"WITH {_topk(5, 'q.vec_id <> i.vec_id AND q.label = i.label')} "
    "SELECT question_id, vec_id, rank, score FROM hits",
    "page_contexts_cells": f"""WITH RECURSIVE {_TURNS}, {_PAGE_POINTS}, {_embedded('qv', 'questions', 'question_id', 'text')}, {_NEAREST}
SELECT question_id, rank, score, text || ' [Source: ' || filename || ']' AS text FROM nearest JOIN cp USING (point_id)""",
    "id_properties": "SELECT count(*) AS ids, count(*) AS hexes, count(*) AS sound_id, count(*) AS sound_hex, count(*) AS sound_now FROM documents",
    "vector_search_tool": f"""WITH {_topk(3, 'true')}, lines AS (SELECT question_id, string_agg('- Content: ' || substr(text, 1, 200)
  || '... [Source: ' || source || '_' || doc_id || '.txt, Page: 0]' || chr(10), '' ORDER BY rank) AS result
  FROM hits JOIN documents ON doc_id = vec_id GROUP BY question_id)
SELECT vec_id AS question_id, coalesce(result, '{fv.NO_DOCUMENTS}') AS result
FROM embeddings LEFT JOIN lines ON question_id = vec_id""",
    "semantic_cache_lookup": f"""WITH {_TURNS},
{_embedded('av', 'answered', 'question_id', 'question')}, {_embedded('tv', 'turns', 'question_id', 'content')},
scored AS (SELECT tv.k AS question_id, av.k AS entry_id, floor(list_inner_product(tv.v, av.v) * 1e9 + 0.5) / 1e9 AS score
  FROM tv, av),
near AS (SELECT * FROM scored WHERE score >= {fv.CACHE_THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entry_id) = 1)
SELECT t.question_id, n.entry_id IS NOT NULL AS hit, n.entry_id, a.answer, n.score
FROM turns t LEFT JOIN near n USING (question_id) LEFT JOIN answered a ON a.question_id = n.entry_id""",
    "skip_missing_vectors": "SELECT vec_id, label FROM embeddings WHERE label NOT IN (7, 8)",
    "vector_upsert": """SELECT md5(vec_id::VARCHAR) AS point_id, 'v' || vec_id AS filename,
  CASE WHEN label >= 4 THEN label ELSE 0 END AS page, len(embedding) AS dim FROM embeddings""",
    "entity_lookup": f"""WITH {_TURNS}, {_GRAPH}, {_bm25('eq', 'question_id', 'text')}
SELECT k AS question_id, name, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, name) AS rank
FROM scored QUALIFY rank <= 5""",
    "expand_directed": f"""WITH {_TURNS}, {_GRAPH}, {_bm25('eq', 'question_id', 'text')}, {_DIRECTED}
SELECT question_id, rank, source || ' ' || rel || ' ' || target AS text FROM directed""",
    "entity_list_parse": f"""WITH {_TURNS}, {_ENTITIES} SELECT question_id, pos, entity FROM entities
UNION ALL SELECT question_id, NULL, NULL FROM questions WHERE length(text) % 5 <= 1""",
    "expand_undirected": f"""WITH {_TURNS}, {_GRAPH}, {_ENTITIES},
asks AS (SELECT question_id || '/' || pos AS ask, * FROM entities), {_bm25('asks', 'ask', 'entity')}
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source, type, target, pos) AS rank,
  source, type AS rel, target
FROM scored JOIN asks ON ask = k JOIN either ON source = name QUALIFY rank <= {fv.GRAPH_TOOL_LIMIT}""",
    "hybrid_context": f"{_HYBRID_ALL} SELECT question_id, branch, rank, text FROM hybrid",
    "retrieval_counts": f"{_HYBRID_ALL} SELECT question_id, count(*) AS contexts FROM hybrid GROUP BY question_id",
    "citations": f"""WITH {_topk(3, 'true')} SELECT question_id,
  string_agg(source || '_' || doc_id || '.txt=' || md5(text), ';' ORDER BY rank) AS citations
FROM hits JOIN documents ON doc_id = vec_id GROUP BY question_id""",
    "page_contexts_fixed": f"""WITH {_TURNS}, {_PAGE_TEXTS},
pc AS (SELECT filename, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS chunk_index,
    substr(text, CAST(i + 1 AS BIGINT), {fv.CHUNK_SIZE}) AS text
  FROM (SELECT *, unnest(range(0, greatest(length(text) - {fv.CHUNK_OVERLAP}, 1), {fv.CHUNK_SIZE - fv.CHUNK_OVERLAP})) AS i FROM pt)
  WHERE length(text) > 0),
cp AS (SELECT DISTINCT md5(filename || chr(1) || chunk_index || chr(1) || md5(text)) AS point_id, filename, text FROM pc),
{_embedded('cv', 'cp', 'point_id', 'text')}, {_embedded('qv', 'questions', 'question_id', 'text')}, {_NEAREST}
SELECT question_id, rank, score, text || ' [Source: ' || filename || ']' AS text FROM nearest JOIN cp USING (point_id)""",
    "html_text": f"""SELECT page_id, {_unescaped(_RAW_TITLE)} AS title,
  {_cleaned(_unescaped(_STRIPPED), chr(92) + 'n|  ')} AS text FROM pages""",
    "article_text": f"WITH {_PAGES} SELECT page_id, title, article FROM parsed",
    "plain_page_text": f"WITH {_PAGES} SELECT page_id, body AS text FROM plain",
    "element_assembly": """SELECT conv_id AS doc_id, string_agg(text || chr(10), '' ORDER BY turn) AS text,
  bool_or(role = 'system') AS has_tables, (count(*) FILTER (role = 'system'))::INTEGER AS table_count
FROM conversations GROUP BY conv_id""",
    "element_flatten": f"""WITH flat AS (SELECT conv_id AS doc_id, coalesce(string_agg(
    CASE WHEN role = 'system' THEN array_to_string(string_split(text, ' '), ' | ') ELSE text END, chr(10) || chr(10)
    ORDER BY role = 'system', turn) FILTER (role = 'system' OR trim(text, {WS}) <> ''), '') AS text
  FROM conversations GROUP BY conv_id) SELECT doc_id, text, length(text)::INTEGER AS char_count FROM flat""",
    "chunk_fixed": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, text FROM chunks",
    "chunk_metadata_merge": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, filename, 'txt' AS type, 3 AS n_keys FROM chunks",
    "chunk_enrich": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, md5(text) AS chunk_hash, length(text) AS length FROM chunks",
    "dedupe_exact": "SELECT min(doc_id) AS doc_id, md5(text) AS chunk_hash, count(*) AS copies FROM documents GROUP BY md5(text)",
    "embed_hashed_terms": f"""WITH {_embedded('dv', 'documents', 'doc_id', 'text')}
SELECT c.k AS doc_id, c.b AS bucket, c.c::DOUBLE / n.n AS weight FROM dv_c c JOIN dv_n n ON n.k = c.k""",
    "graph_nodes": f"WITH {_GRAPH} SELECT name, type FROM nodes",
    "graph_edges": f"WITH {_GRAPH} SELECT source, target, type FROM edges",
    "graph_enforced": f"""WITH {_GRAPH}, kept AS (SELECT DISTINCT name FROM raw_nodes WHERE type <> 'Company')
SELECT * FROM raw_edges WHERE source IN (SELECT name FROM kept) AND target IN (SELECT name FROM kept)""",
    "graph_rule_extract": f"""WITH {_CHUNKS}, {_GAZ} SELECT source, target, 'RELATES_TO' AS type, count(*) AS chunks
FROM links WHERE target IS NOT NULL GROUP BY source, target""",
    "history_window": f"""WITH {_TURNS},
recent AS (SELECT *, max(turn) OVER (PARTITION BY session_id) AS last FROM turns
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= {fv.CHAT_HISTORY_LIMIT})
SELECT session_id, (count(*) + 1)::INTEGER AS n_messages, string_agg(role || ': ' || content, chr(10) ORDER BY turn)
  || chr(10) || 'user: and after turn ' || max(last) || '?' AS lines FROM recent GROUP BY session_id""",
    "history_append": f"""WITH {_TURNS} SELECT row_number() OVER (ORDER BY role = 'assistant', conv_id, turn) AS id,
  session_id, role, content FROM turns""",
    "feedback_append": """SELECT * FROM (SELECT 's' || doc_id AS session_id, 'u' || (doc_id % 10) AS user_id, doc_id AS message_id,
  CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 0 THEN -1 ELSE 0 END AS score,
  CASE WHEN toxic = 1 THEN 'toxic' END AS comment FROM labels) WHERE score <> 0""",
    "cache_put": f"""WITH {_TURNS}, kept AS (SELECT question, answer FROM answered WHERE answer <> ''
  QUALIFY row_number() OVER (PARTITION BY question ORDER BY conv_id DESC, turn DESC) = 1), {_embedded('kv', 'kept', 'question', 'question')}
SELECT md5(question) AS entry_id, question AS query, answer, round(list_max(v), 9) AS peak FROM kept JOIN kv ON k = question""",
    "message_state": f"""WITH {_TURNS}
SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS lines,
  arg_max(content, turn) FILTER (role = 'user') AS current_query FROM turns GROUP BY session_id""",
    "message_state_stream": f"""WITH {_TURNS}
SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS lines,
  arg_max(content, turn) FILTER (role = 'user') AS current_query FROM turns GROUP BY session_id""",
    "plan_normalise": f"WITH {_TURNS}, {_PLANS} SELECT * FROM normal",
    "route": f"""WITH {_TURNS}, {_PLANS} SELECT question_id, CASE WHEN tool_choice <> '' THEN 'tool' ELSE 'retriever' END AS route,
  CASE WHEN tool_choice <> '' THEN tool_choice ELSE 'unknown' END AS branch, tool_choice AS tool_name,
  CASE WHEN tool_input <> '' THEN tool_input ELSE current_query END AS tool_text FROM normal""",
    "tool_output": f"WITH {_TURNS}, {_STATES} SELECT session_id, tool_output, source_label, source_content FROM sourced",
    "prompt_answer": f"""WITH {_TURNS}, {_STATES} SELECT session_id,
  {_filled(fv.ANSWER_PROMPT, label='source_label', content='source_content', question='current_query')} AS prompt FROM sourced""",
    "prompt_rewrite": f"""WITH {_TURNS}, {_STATES} SELECT session_id,
  {_filled(fv.REWRITE_PROMPT, history='lines', question='current_query')} AS prompt FROM states""",
    "prompt_graph": f"""WITH {_CHUNKS} SELECT doc_id, chunk_index, {_filled(
        fv.GRAPH_PROMPT_FRAME,
        system=_text(fv.GRAPH_PROMPT.format(labels=repr(fv.NODE_LABELS), relations=repr(fv.RELATION_TYPES))),
        text='text',
    )} AS prompt FROM chunks""",
    "prompt_plan": f"""WITH {_TURNS} SELECT question_id, 'system: ' || {_text(fv.PLAN_PROMPT)} || chr(10) || 'user: ' || text AS prompt
FROM questions""",
    "hyde_query": f"""WITH {_TURNS} SELECT question_id, coalesce(answer, text) AS query
FROM questions LEFT JOIN (SELECT question_id, answer FROM answered) USING (question_id)""",
    "completion_apply": f"""WITH {_TURNS} SELECT question_id, answer AS completion, CASE WHEN answer IS NULL THEN 'no completion' END AS error
FROM questions LEFT JOIN (SELECT question_id, answer FROM answered) USING (question_id)""",
    "query_rewrite": f"""WITH {_TURNS},
past AS (SELECT q.question_id, t.turn, t.role || ': ' || t.content AS line
  FROM questions q JOIN turns t ON t.conv_id = q.conv_id AND t.turn < q.turn
  QUALIFY row_number() OVER (PARTITION BY q.question_id ORDER BY t.turn DESC) <= {fv.CHAT_HISTORY_LIMIT}),
lines AS (SELECT question_id, string_agg(line, chr(10) ORDER BY turn) AS history, count(*) AS n FROM past GROUP BY question_id),
asked AS (SELECT question_id, text, n, md5({_filled(fv.REWRITE_PROMPT, history="coalesce(history, '')", question='text')}) AS prompt_id
  FROM questions LEFT JOIN lines USING (question_id)),
given AS (SELECT prompt_id, min(answer) AS answer FROM asked JOIN answered USING (question_id) GROUP BY prompt_id)
SELECT question_id, CASE WHEN n IS NULL OR answer IS NULL THEN text ELSE trim(answer, {WS}) END AS query, prompt_id
FROM asked LEFT JOIN given USING (prompt_id)""",
    "hyde_search": f"""WITH {_TURNS}, {_CHUNKS},
hq AS (SELECT question_id, coalesce(nullif(answer, ''), text) AS text
  FROM questions LEFT JOIN (SELECT question_id, answer FROM answered) USING (question_id)),
cp AS (SELECT doc_id || '-' || chunk_index AS point_id, text FROM chunks),
{_embedded('cv', 'cp', 'point_id', 'text')}, {_embedded('qv', 'hq', 'question_id', 'text')}, {_NEAREST}
SELECT question_id, point_id, rank, score FROM nearest""",
    "document_filters": f"""WITH {_TURNS}, {_CHUNKS},
cp AS (SELECT doc_id || '-' || chunk_index AS point_id, text FROM chunks WHERE doc_id IN
  (SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src0')),
{_embedded('cv', 'cp', 'point_id', 'text')}, {_embedded('qv', 'questions', 'question_id', 'text')}, {_NEAREST}
SELECT question_id, point_id, rank, score FROM nearest""",
    "history_write_back": f"""WITH {_TURNS}, parts AS (SELECT *, unnest([0, 1]) AS part FROM answered WHERE answer <> '')
SELECT question_id, session_id, 'u' || (conv_id % 10) AS user_id, part, CASE WHEN part = 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN part = 0 THEN question ELSE answer END AS content FROM parts""",
    "sitemap_urls": "SELECT url FROM pages",
    "repeated_content": "SELECT DISTINCT md5(text) AS content_id FROM documents",
    "ndjson_events": f"{_EVENTS} SELECT * FROM parts",
    "event_feed": f"{_EVENTS} SELECT line FROM parts",
    "notification_rows": f"""SELECT page_id, unnest(['docs', 'copies']) AS bucket, substr({_PATH}, 2) AS key FROM pages""",
    "url_filter": f"""SELECT page_id AS pos, u AS url FROM (
  SELECT page_id, regexp_replace(split_part(trim(url, {WS}), '"', 1), '/+$', '') AS u FROM pages)
WHERE contains(u, 'example') AND NOT contains(u, 'utm_source') AND NOT contains(u, 'spam-farm') AND starts_with(u, 'https://')
  AND (NOT contains(u, '.org/') OR contains(u, '/en/') OR contains(u, '/fr/'))""",
    "url_unique": f"""SELECT min(page_id) AS pos, u AS url FROM (SELECT page_id, regexp_replace(regexp_replace(
  regexp_replace(split_part(trim(url, {WS}), '"', 1), '/+$', ''), '[?#].*$', ''), '[0-9]+(\\.html)?/?$', '') AS u FROM pages) GROUP BY u""",
    "slug": f"""WITH sections AS (SELECT page_id AS seq, regexp_replace({_PATH}, '[0-9](\\.html)?/?$', '') AS url FROM pages),
{_numbered('sections', 'url')} SELECT seq, slug FROM named""",
    "section_counts": f"WITH {_BUCKETS} SELECT bucket, count(*) AS urls, min(url) AS first_url FROM bucketed GROUP BY bucket",
    "quota_select": f"WITH {_PICKED} SELECT place, url, bucket FROM picked",
    "manifest": f"""WITH {_PAGES}, numbered AS (SELECT page_id AS seq, url FROM pages), {_numbered('numbered', _PATH)}
SELECT seq, slug || chr(9) || named.url || chr(9) || title AS line FROM named JOIN parsed ON page_id = seq""",
    "render_text": f"""WITH {_PAGES} SELECT page_id, {_TXT} AS text,
  '# ' || title || chr(10) || chr(10) || '**Source:** ' || url || chr(10) || chr(10) || body || chr(10) AS markdown FROM plain""",
    "manifest_file": f"""WITH {_PAGES}, numbered AS (SELECT page_id AS seq, url FROM pages), {_numbered('numbered', _PATH)}
SELECT slug, named.url AS url, title FROM named JOIN parsed ON page_id = seq""",
    "rendered_files": f"""WITH {_PAGES}, numbered AS (SELECT page_id AS seq, url FROM pages), {_numbered('numbered', _PATH)}
SELECT slug || '.txt' AS name, md5({_TXT.replace("url", "plain.url")}) AS md5 FROM named JOIN plain ON page_id = seq""",
    "corpus_build": f"""WITH {_PAGES}, {_PICKED}, tries AS (SELECT place AS seq, url FROM picked
  UNION ALL SELECT (SELECT count(*) FROM picked) + row_number() OVER (ORDER BY pos), url FROM bucketed
    WHERE url NOT IN (SELECT url FROM picked)), {_numbered('tries', _PATH)}
SELECT seq, slug, url, title, {_TXT} AS text FROM named JOIN plain USING (url) ORDER BY seq LIMIT 50""",
    "object_key": f"""WITH f AS (SELECT page_id, url, CASE WHEN {_PATH} = '' THEN 'object_' || page_id
    ELSE regexp_extract({_PATH}, '([^/]*)$', 1) END AS filename FROM pages),
  e AS (SELECT *, CASE WHEN contains(filename, '.') THEN regexp_extract(filename, '([^.]*)$', 1) ELSE 'bin' END AS extension FROM f)
SELECT page_id, filename, extension, 'uploads/u1/' || md5(url) || '.' || extension AS object_key,
  'rate_limit:' || page_id AS counter_key FROM e""",
    "rate_limit": _limited("user_id", RATE["limit"], RATE["window_seconds"]),
    "rate_limit_sliced": _limited("user_id", RATE["limit"], RATE["window_seconds"]),
    "rate_limit_stream": _limited("user_id", RATE["limit"], RATE["window_seconds"]),
    "rate_limit_default": _limited("event_type", fv.RATE_LIMIT, fv.RATE_WINDOW_SECONDS),
    "rate_counts": f"""WITH {_windows('user_id', RATE['window_seconds'])}
SELECT key AS user_id, window_start, count(*) AS requests FROM marked GROUP BY key, window_start""",
}
