"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from stratadoc.llm import quality_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


#: Levels that the SQL of the manifest folds: sources of up to 3 ** 12 rows, and 3 ** 7 sources.
_SOURCE_LEVELS, _TABLE_LEVELS = 12, 7


def _merkle() -> str:
    def field(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"

    def row_hash(text: str) -> str:
        return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"

    def up(name: str, k: int, key: str) -> str:
        """Level ``k`` + 1 of the nodes, and the runs of level ``k``."""
        return f"""
), {name}_runs{k} AS (
  SELECT {key}, pos // 3 AS run, n, list(h ORDER BY pos) AS nodes FROM {name}{k} GROUP BY {key}, pos // 3, n
), {name}{k + 1} AS (
  SELECT {key}, run AS pos, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS h FROM {name}_runs{k}"""

    def along(path: str, name: str, k: int, key: str) -> str:
        """Level ``k`` + 1 of the rows on their way to the root: their fold and their siblings so far."""
        left, right = "array_to_string(r.nodes[1:p.pos % 3], '')", "array_to_string(r.nodes[p.pos % 3 + 2:], '')"
        return f"""
), {path}{k + 1} AS (
  SELECT p.id, p.source, p.pos // 3 AS pos,
    CASE WHEN r.n > 1 THEN sha256({left} || p.folded || {right}) ELSE p.folded END AS folded,
    CASE WHEN r.n > 1 THEN p.proof || {left} || {right} ELSE p.proof END AS proof
  FROM {path}{k} p JOIN {name}_runs{k} r ON p.{key} IS NOT DISTINCT FROM r.{key} AND p.pos // 3 = r.run"""

    crc_table = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), "
        "lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])))"
    )
    sql = f"""
WITH hashed AS (
  SELECT *, {row_hash("text")} AS leaf,
    CASE WHEN coalesce({crc} % 2 = 0, FALSE) THEN {row_hash("replace(text, chr(10), '')")} ELSE {row_hash("text")} END AS changed
  FROM documents, (SELECT {crc_table} AS crcs)
), ordered AS (
  SELECT row_number() OVER () AS id, doc_id, source, leaf, changed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), leaf0 AS (
  SELECT source, pos, n, leaf AS h FROM ordered"""
    sql += "".join(up("leaf", k, "source") for k in range(_SOURCE_LEVELS))
    sql += f"""
), subroots AS (
  SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM leaf{_SOURCE_LEVELS}
), top0 AS (
  SELECT 0 AS one, pos, n, h FROM subroots"""
    sql += "".join(up("top", k, "one") for k in range(_TABLE_LEVELS))
    sql += """
), way0 AS (
  SELECT id, source, pos, changed AS folded, '' AS proof FROM ordered"""
    sql += "".join(along("way", "leaf", k, "source") for k in range(_SOURCE_LEVELS))
    sql += f"""
), climb0 AS (
  SELECT w.id, w.source, s.pos, w.folded, w.proof, 0 AS one FROM way{_SOURCE_LEVELS} w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source"""
    for k in range(_TABLE_LEVELS):
        sql += along("climb", "top", k, "one").replace("p.pos // 3 AS pos,", "p.pos // 3 AS pos, p.one,")
    return sql + f"""
)
SELECT o.doc_id, o.leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = t.h AS verified
FROM ordered o JOIN climb{_TABLE_LEVELS} c USING (id) JOIN subroots s ON o.source IS NOT DISTINCT FROM s.source, top{_TABLE_LEVELS} t
"""


def _quality() -> str:
    def passes(rule: quality_rules.Rule) -> str:
        limits = [f"{rule.measure} * 1000 >= {rule.base} * {rule.low}"] if rule.low is not None else []
        limits += [f"{rule.measure} * 1000 <= {rule.base} * {rule.high}"] if rule.high is not None else []
        return "(" + " AND ".join(limits) + ")"

    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), windows AS (
  SELECT id, s, count(*) OVER (PARTITION BY id, g) AS times
  FROM (SELECT id, s, array_to_string(words[s:s + 2], ' ') AS g FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS s FROM w))
), repeats AS (
  SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(s, s + 3)) AS place FROM windows WHERE times > 1) GROUP BY id
), measures AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: {_lower("x")} IN ({stops}))) AS BIGINT) AS n_stop_words,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_list_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_broken_lines
  FROM w LEFT JOIN repeats r USING (id)
), based AS (
  SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed
  FROM measures
)
SELECT *, NOT base_failed AND {" AND ".join(passes(r) for r in quality_rules.RULES)} AS kept,
  array_to_string([x for x in [{", ".join(f"CASE WHEN NOT {passes(r)} THEN '{r.name}' END" for r in quality_rules.RULES)}] if x IS NOT NULL], ',') AS broken_rules
FROM based
"""


ORACLE = {
    "op12_merkle": _merkle(),
    "op13_quality_rules": _quality(),
    "op1_url_rules": rf"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, url, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rule, rule_verdict, rule_host, rule_path) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
    ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule,
  CASE WHEN b.rule IS NOT NULL THEN b.rule_verdict
    WHEN regexp_matches(coalesce(p.url, ''), '(?i)[./?=&_-](casino|porn|free-torrent)[./?=&_-]') THEN 'block'
    ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
""",
    "op4_embedding_dups": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen
), component AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT a, count(*) AS n_links FROM link GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component ON node = v.vec_id LEFT JOIN degree ON a = v.vec_id
""",
    "op5_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM (SELECT *, least(10, len(w)) AS n FROM i WHERE len(w) > 0))
), hits AS (
  SELECT x.doc_id, x.s, x.n, x.k
  FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
      FROM d, (SELECT DISTINCT n FROM item_windows))) x
  JOIN (SELECT DISTINCT n, k FROM item_windows) y ON x.n = y.n AND x.k = y.k
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN item_windows USING (n, k)) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
""",
    "op10_minmax_dups": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM w WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * k >= 80 * (sa.n + sb.n - k)
), link AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.seen
)
SELECT w.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(seen) AS component_id, w.doc_id = min(seen) AS kept
FROM w JOIN reach ON node = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id GROUP BY w.doc_id
""",
}
