"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables.

Operators 1, 2, 4, 5, 6, 7 and 13 have none: a fitted forest, fitted trees, a keyed permutation, a Dice search with pruned
templates, an optimal partition, a byte-pair merge and an approximate search are held against brute force in tests instead.
"""

from newsloom.llm.quality_rules import RULES, STOP_WORDS
from newsloom.llm.url_filter import BLOCK_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _verdict() -> str:
    parts = ["NOT base_failed"]
    for r in RULES:
        per = r.per or "1"
        if r.low is not None:
            parts.append(f"{r.metric} >= CAST({r.low} AS DOUBLE) * {per}")
        if r.high is not None:
            parts.append(f"{r.metric} <= CAST({r.high} AS DOUBLE) * {per}")
    return " AND ".join(parts)


# The rules of the url query, as (rule, host, path, verdict).
_RULE_ROWS = """(VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')) AS r(rule, rule_host, rule_path, rule_verdict)"""



def _codes() -> str:
    """Six Lloyd rounds and the last assignment, one pair of CTEs each."""
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(7):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, label, part, x, entry, dist FROM (
    SELECT p.vec_id, label, p.part, x, entry, CAST({square} AS BIGINT) AS dist FROM p JOIN b{i} ON p.part = b{i}.part)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1)""")
        if i < 6:
            steps.append(f"""m{i} AS (SELECT part, entry, list(m ORDER BY j) AS m FROM (
    SELECT part, entry, j, CAST(floor(CAST(sum(x[j]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM (SELECT *, unnest(range(1, 9)) AS j FROM a{i}) GROUP BY part, entry, j) GROUP BY part, entry),
b{i + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m, c) AS c FROM b{i} o LEFT JOIN m{i} n ON o.part = n.part AND o.entry = n.entry)""")
    return """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * 8 + 1, part * 8 + 8) AS x
  FROM (SELECT *, unnest(range(0, 8)) AS part FROM v)),
b0 AS MATERIALIZED (SELECT part, x AS c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p
  QUALIFY entry < 16),
""" + ",\n".join(steps) + """,
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM a6 GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, book"""


# Reflected CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

ORACLE: dict[str, str] = {
    "op11_vector_codes": _codes(),
    "op12_prefix_trie": f"""WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT conv_id, s, CAST({_CRC} % 6 AS INTEGER) AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.s, 1, h), []), list_slice(c.s, h + 1, len(c.s))) AS s
  FROM headed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefix AS (SELECT conv_id, d, list_slice(s, 1, d) AS p, len(s) AS n FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
node AS MATERIALIZED (SELECT p, d, min(conv_id) AS name, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefix GROUP BY p, d),
above AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
full_ AS MATERIALIZED (SELECT node.*, coalesce(above.n, 0) AS n_children, (n_convs - 1) * coalesce(length(p[d].text), 0) AS w
  FROM node LEFT JOIN above USING (p, d)),
under AS (SELECT k AS d, list_slice(p, 1, k) AS p, w, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_)),
sums AS (SELECT p, d, sum(w) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM under GROUP BY p, d)
SELECT f.name AS conv_id, CAST(f.d AS BIGINT) AS depth, u.name AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN sums USING (p, d) LEFT JOIN node u ON u.d = f.d - 1 AND u.p = list_slice(f.p, 1, f.d - 1) AND f.d > 0""",
    "op3_url_filter": f"""WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
hosts AS (SELECT DISTINCT host FROM u WHERE host <> ''),
blocked AS (SELECT host AS entry FROM hosts
  WHERE list_has_any(string_split_regex(host, '[.-]'), [{_strings(BLOCK_WORDS)}])),
ruled AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM u JOIN {_RULE_ROWS} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
listed AS (SELECT h.host, arg_max(entry, length(entry)) AS listed
  FROM hosts h JOIN blocked b ON h.host = b.entry OR ends_with(h.host, '.' || b.entry) GROUP BY h.host)
SELECT u.page_id, u.host, path, rule,
  coalesce(rule_verdict, CASE WHEN listed IS NOT NULL THEN 'block' END, 'allow') AS verdict, listed
FROM u LEFT JOIN ruled USING (page_id) LEFT JOIN listed ON u.host = listed.host""",
    "op8_topk": """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_quality_rules": rf"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i,
    unnest(list_transform(range(1, len(w) - 6), lambda i: list_slice(w, i, i + 7))) AS eight FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, eight) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_strings(STOP_WORDS)}))) AS n_stop_words, len(lines) AS n_lines,
    len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(\.\.\.|…)$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {_verdict()} AS kept FROM b""",
    "op10_near_dup": rf"""WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id,
    unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
}
