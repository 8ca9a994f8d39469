"""DuckDB oracle SQL for the registered queries (same column names as the Spark side)."""

from __future__ import annotations

from newsloom.operators.ingest import DEFAULT_QUERY
from newsloom.plans import duck as D
from newsloom.plans import params as P
from newsloom.sources.fixtures import adapter_sql, raw_landed_sql

ORACLE: dict[str, str] = {}

RAW_ITEMS = f"""
items AS ({adapter_sql('items')}),
parsed AS (SELECT *, TRY_CAST(NULLIF(trim(published_at_text), '') AS TIMESTAMP) AS published_at FROM items),
cleaned AS (
  SELECT item_ord, {D.clean_default('source_name', 'unknown')} AS source_name, CAST(NULL AS VARCHAR) AS source_id,
    {D.clean('title')} AS title, {D.clean('url')} AS url, {D.clean_null('author')} AS author,
    {D.clean_null('description')} AS description, {D.clean_null('content')} AS content, published_at,
    {D.ts(P.AS_OF)} AS fetched_at, '{DEFAULT_QUERY}' AS query, {D.norm_batch('run_id')} AS batch_id, language
  FROM parsed WHERE published_at IS NOT NULL AND published_at > {D.ts(P.SINCE)}),
raw AS (
  SELECT sha256(source_name || '|' || title || '|' || url || '|' || {D.iso('published_at')}) AS article_id, *
  FROM cleaned WHERE title <> '' AND url <> ''),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY published_at DESC, item_ord) AS rn FROM raw),
clean_raw AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1),
processed AS (
  SELECT article_id, title, source_name, published_at, CAST(published_at AS DATE) AS published_date,
    coalesce(content, '') AS content, coalesce(description, '') AS description,
    CAST(length(coalesce(NULLIF(content, ''), NULLIF(description, ''), '')) AS BIGINT) AS content_length,
    url, 'unknown' AS sentiment_placeholder, batch_id AS ingestion_batch_id, query
  FROM clean_raw)
"""

ORACLE["raw_articles"] = f"WITH {RAW_ITEMS} SELECT * FROM raw"
ORACLE["dedup_keep_first"] = f"WITH {RAW_ITEMS} SELECT * FROM clean_raw"
ORACLE["processed_articles"] = f"WITH {RAW_ITEMS} SELECT * FROM processed"
ORACLE["daily_counts"] = f"""WITH {RAW_ITEMS}
SELECT published_date, source_name, count(*) AS article_count,
  count(*) FILTER (WHERE content_length > 0) AS sentiment_ready_count
FROM processed GROUP BY 1, 2"""

PARSED_ITEMS = f"""
items AS ({adapter_sql('items')}),
parsed AS (SELECT *, TRY_CAST(NULLIF(trim(published_at_text), '') AS TIMESTAMP) AS published_at FROM items)
"""

ORACLE["newest_items_topk"] = f"""WITH {PARSED_ITEMS}
SELECT item_ord, published_at_text, published_at, title FROM parsed
ORDER BY published_at DESC NULLS LAST, item_ord LIMIT 500"""

ORACLE["batch_summary"] = f"""WITH {RAW_ITEMS}
SELECT count(*) AS article_count, count(DISTINCT source_name) AS source_count,
  CAST(to_json(list_sort(list(DISTINCT source_name))) AS VARCHAR) AS sources_json,
  {D.iso('max(published_at)')} AS latest_published_at
FROM processed"""

ORACLE["quality_summary"] = f"""WITH {RAW_ITEMS}, c AS (
  SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM clean_raw) AS k)
SELECT r AS raw_article_count, k AS cleaned_article_count, greatest(r - k, 0) AS duplicate_article_count,
  CASE WHEN r = 0 THEN 1.0 ELSE round(k / r, 4) END AS deduplication_rate FROM c"""

ORACLE["training_metadata"] = f"""WITH {RAW_ITEMS}
SELECT 'news_pipeline_processed_table' AS training_source, count(*) AS article_count,
  {D.iso('max(published_at)')} AS latest_published_at,
  'published_date, source_name, content_length, sentiment_placeholder' AS feature_hint
FROM processed"""

ORACLE["training_snapshot"] = f"""WITH {RAW_ITEMS}
SELECT article_id, strftime(published_date, '%Y-%m-%d') AS published_date, source_name, content_length,
  sentiment_placeholder, query FROM processed"""

_kw = [p.strip().lower() for p in P.KEYWORDS.split(" OR ")]
_kw_pred = " OR ".join(f"contains(lower(coalesce({c}, '')), '{p}')" for p in _kw
                       for c in ("title", "description", "content"))
ORACLE["keyword_filter"] = f"WITH {RAW_ITEMS} SELECT article_id, title, source_name FROM raw WHERE {_kw_pred}"

ORACLE["source_list_filter"] = f"""WITH {RAW_ITEMS}
SELECT article_id, source_name, url FROM raw
WHERE list_contains(list_filter(list_transform(string_split('{P.SOURCE_LIST}', ','), lambda x: trim(x)), lambda x: x <> ''),
                    source_name)"""

ORACLE["language_filter"] = f"WITH {RAW_ITEMS} SELECT article_id, language, title FROM raw WHERE language = '{P.LANGUAGE}'"


def elt_sql(src: str) -> str:
    return f"""
SELECT article_id, {D.utrim('title')} AS title, {D.utrim('source_name')} AS source_name, published_at,
  CAST(published_at AS DATE) AS published_date, {D.trim_null('content')} AS content,
  {D.trim_null('description')} AS description,
  CAST(coalesce(length({D.trim_null('content')}), length({D.trim_null('description')}), 0) AS BIGINT) AS content_length,
  {D.utrim('url')} AS url, 'unknown' AS sentiment_placeholder, batch_id AS ingestion_batch_id, query
FROM (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY fetched_at DESC, batch_id DESC) AS rn
  FROM {src} WHERE article_id IS NOT NULL AND title IS NOT NULL AND source_name IS NOT NULL
    AND published_at IS NOT NULL AND url IS NOT NULL) WHERE rn = 1)"""


RAW = f"raw AS ({raw_landed_sql()})"
STG = f"""stg AS (
  SELECT article_id, {D.utrim('title')} AS title, {D.utrim('source_name')} AS source_name, source_id,
    {D.trim_null('author')} AS author, {D.trim_null('description')} AS description,
    {D.trim_null('content')} AS content, {D.utrim('url')} AS url, published_at, fetched_at, query, batch_id,
    language, CAST(published_at AS DATE) AS published_date,
    CAST(length(coalesce(content, description, '')) AS BIGINT) AS content_length
  FROM raw)"""
MART = """
SELECT published_date, source_name, count(*) AS article_count,
  count(*) FILTER (WHERE content_length > 0) AS sentiment_ready_count,
  count(DISTINCT article_id) AS distinct_article_count
FROM stg GROUP BY 1, 2"""

ORACLE["elt_processed"] = f"WITH {RAW} {elt_sql('raw')}"
ORACLE["stg_articles"] = f"WITH {RAW}, {STG} SELECT * FROM stg"
ORACLE["fct_daily_counts"] = f"WITH {RAW}, {STG} {MART}"
ORACLE["model_build"] = ORACLE["fct_daily_counts"]
ORACLE["retention_filter"] = f"""WITH {RAW}
SELECT article_id, batch_id, fetched_at, url FROM raw
WHERE fetched_at >= {D.ts(P.RETENTION_AS_OF)} - INTERVAL {P.RETENTION_DAYS} DAY"""

_stored = P.SINCE.replace(" ", "T") + "+00:00"
ORACLE["watermark_next"] = f"""WITH {RAW_ITEMS}
SELECT '{P.MARK_NAME}' AS name, '{_stored}' AS stored, {D.ts(P.SINCE)} AS since,
  coalesce({D.iso('max(published_at)')}, '{_stored}') AS value, {D.ts(P.AS_OF)} AS updated_at
FROM raw"""

ORACLE["landing_roundtrip"] = f"""WITH {RAW_ITEMS}
SELECT DISTINCT article_id, title, source_name, source_id, author, description, content, url, published_at,
  fetched_at, query, batch_id, language FROM raw"""

ORACLE["elt_upsert"] = f"""WITH {RAW},
b1 AS ({elt_sql("(SELECT * FROM raw WHERE batch_id = 'batch_1')")}),
b2 AS ({elt_sql("(SELECT * FROM raw WHERE batch_id = 'batch_2')")})
SELECT * FROM b1 WHERE article_id NOT IN (SELECT article_id FROM b2)
UNION ALL SELECT * FROM b2"""

ORACLE["batch_replace"] = f"""WITH {RAW}
SELECT article_id, CASE WHEN batch_id = 'batch_2' THEN {D.utrim('title')} ELSE title END AS title,
  source_name, description, content, url, published_at, fetched_at, query, language, batch_id FROM raw"""

# ---- property graph ---------------------------------------------------------------------------------
from newsloom.functions.text import STATUS_SYNONYMS  # noqa: E402
from newsloom.operators import extract as _X  # noqa: E402

NODES = f"nodes AS ({adapter_sql('nodes')})"
EDGES = f"edges AS ({adapter_sql('edges')})"
G = f"{NODES}, {EDGES}"
RESOLVED = """resolved AS (
  SELECT e.source_id, e.target_id, e.type, s.label AS source_label, s.name AS source_name,
    t.label AS target_label, t.name AS target_name
  FROM edges e JOIN nodes s ON e.source_id = s.id JOIN nodes t ON e.target_id = t.id)"""
_NEG = -(1 << 62)

ORACLE["node_upsert"] = f"""WITH {NODES}, b0 AS ({adapter_sql('node_batch')}),
b AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY ord DESC, name DESC NULLS LAST, a1 DESC NULLS LAST, a2 DESC NULLS LAST) AS rn FROM b0) WHERE rn = 1)
SELECT coalesce(t.label, b.label) AS label, coalesce(t.id, b.id) AS id,
  CASE WHEN b.id IS NOT NULL THEN b.name ELSE t.name END AS name,
  CASE WHEN b.id IS NOT NULL THEN b.a1 ELSE t.a1 END AS a1,
  CASE WHEN b.id IS NOT NULL THEN b.a2 ELSE t.a2 END AS a2,
  CASE WHEN b.id IS NOT NULL THEN {D.ts(P.GRAPH_AS_OF)} END AS created_at,
  CASE WHEN b.id IS NOT NULL THEN {D.ts(P.GRAPH_AS_OF)} END AS last_updated
FROM nodes t FULL OUTER JOIN b ON t.label = b.label AND t.id = b.id"""

ORACLE["edge_resolve"] = f"WITH {G}, {RESOLVED} SELECT source_id, target_id, type, source_label, target_label FROM resolved"

ORACLE["edge_upsert"] = f"""WITH {G}, batch AS ({adapter_sql('edge_batch')}),
ids AS (SELECT DISTINCT id FROM nodes),
b AS (SELECT * FROM batch WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)),
ent AS (
  SELECT source_id, type, target_id, {_NEG} AS ord, 'origin' AS k, 'seed' AS v FROM edges
  UNION ALL SELECT source_id, type, target_id, {_NEG}, 'kind', type FROM edges
  UNION ALL SELECT source_id, type, target_id, ord, 'qty', qty FROM b
  UNION ALL SELECT source_id, type, target_id, ord, 'flag', flag FROM b),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, type, target_id, k ORDER BY ord DESC, v DESC NULLS LAST) AS rn
                       FROM ent) WHERE rn = 1 AND v IS NOT NULL),
props AS (SELECT source_id, type, target_id, string_agg(k || '=' || v, ';' ORDER BY k) AS props FROM win GROUP BY 1, 2, 3),
allk AS (SELECT DISTINCT source_id, type, target_id FROM ent),
touched AS (SELECT DISTINCT source_id, type, target_id FROM b)
SELECT a.source_id, a.type, a.target_id, p.props,
  CASE WHEN t.source_id IS NOT NULL THEN {D.ts(P.GRAPH_AS_OF)} ELSE {D.ts(P.EDGE_SEED_TIME)} END AS ingested_at
FROM allk a LEFT JOIN props p USING (source_id, type, target_id) LEFT JOIN touched t USING (source_id, type, target_id)"""

ORACLE["orphan_edges"] = f"""WITH {G}, ids AS (SELECT DISTINCT id FROM nodes)
SELECT source_id, target_id, type,
  CASE WHEN source_id NOT IN (SELECT id FROM ids) AND target_id NOT IN (SELECT id FROM ids) THEN 'missing_both'
       WHEN source_id NOT IN (SELECT id FROM ids) THEN 'missing_source' ELSE 'missing_target' END AS reason
FROM edges WHERE source_id NOT IN (SELECT id FROM ids) OR target_id NOT IN (SELECT id FROM ids)"""

ORACLE["model_details"] = f"""WITH {G},
runs AS (SELECT id AS run_id, name AS run_name, a1 AS run_status FROM nodes WHERE label = 'Run'),
produced AS (SELECT e.source_id AS model_id, r.* FROM edges e JOIN runs r ON e.target_id = r.run_id WHERE e.type = 'PRODUCED_BY')
SELECT m.id AS model_id, m.name AS model_name, m.a1 AS model_version, p.run_id, p.run_name, p.run_status
FROM nodes m LEFT JOIN produced p ON p.model_id = m.id WHERE m.label = 'Model'"""

ORACLE["deployment_status"] = f"""WITH {G}
SELECT d.id AS deployment_id, d.name AS deployment_name, d.a1 AS cluster, m.id AS model_id, m.name AS model_name
FROM nodes d JOIN edges e ON e.source_id = d.id AND e.type = 'SERVES' JOIN nodes m ON e.target_id = m.id AND m.label = 'Model'
WHERE d.label = 'Deployment'"""


def _typed(etype, sl, tl, a, b):
    return (f"(SELECT DISTINCT e.source_id AS {a}, e.target_id AS {b} FROM edges e WHERE e.type = '{etype}' "
            f"AND e.source_id IN (SELECT id FROM nodes WHERE label = '{sl}') "
            f"AND e.target_id IN (SELECT id FROM nodes WHERE label = '{tl}'))")


ORACLE["lineage"] = f"""WITH {G},
serves AS (SELECT * FROM {_typed('SERVES', 'Deployment', 'Model', 'deployment_id', 'model_id')}),
produced AS (SELECT * FROM {_typed('PRODUCED_BY', 'Model', 'Run', 'model_id', 'run_id')}),
belongs AS (SELECT * FROM {_typed('BELONGS_TO', 'Run', 'Experiment', 'run_id', 'experiment_id')})
SELECT s.deployment_id, count(DISTINCT s.model_id) AS model_count,
  CAST(count(DISTINCT (s.model_id, p.run_id)) AS BIGINT) AS run_paths,
  CAST(count(b.experiment_id) AS BIGINT) AS experiment_paths
FROM serves s LEFT JOIN produced p USING (model_id) LEFT JOIN belongs b USING (run_id) GROUP BY 1"""

_status_case = ("CASE lower(trim(a1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_SYNONYMS.items())
                + " ELSE a1 END")
ORACLE["node_projection"] = f"""WITH nodes AS ({adapter_sql('open_nodes')})
SELECT id, label, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  CASE WHEN label = 'Model' THEN a1 END AS version,
  CASE WHEN label = 'Model' THEN coalesce(a2, 'pytorch') END AS framework,
  CASE WHEN label = 'Experiment' THEN coalesce({_status_case}, 'active')
       WHEN label = 'Run' THEN coalesce({_status_case}, 'completed') END AS status,
  CASE WHEN label = 'Deployment' THEN coalesce(a1, 'local-k8s') END AS cluster,
  CASE WHEN label = 'Model' THEN json_extract_string(props_text, '$.description') END AS description,
  CASE WHEN label = 'Deployment' THEN json_extract_string(props_text, '$.image') END AS image,
  CASE WHEN label = 'Deployment' THEN coalesce(CAST(json_extract_string(props_text, '$.replicas') AS BIGINT), 1) END AS replicas,
  CASE WHEN label = 'Run' THEN CAST(json_extract_string(props_text, '$.metrics.accuracy') AS DOUBLE) END AS accuracy,
  CASE WHEN label = 'Run' THEN json_extract_string(props_text, '$.parameters.user') END AS parameter_user
FROM nodes"""

ORACLE["name_lookup"] = f"WITH {NODES} SELECT id, label, name, a1 FROM nodes WHERE name = '{P.LOOKUP_NAME}'"
ORACLE["graph_schema"] = f"""WITH {G}, {RESOLVED}
SELECT source_label, type, target_label, count(*) AS edge_count FROM resolved GROUP BY 1, 2, 3"""
ORACLE["label_scan"] = f"WITH {NODES} SELECT id, name, a1 FROM nodes WHERE label = 'Model' ORDER BY id LIMIT {P.LABEL_SCAN_LIMIT}"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


ORACLE["prompt_extract"] = f"""SELECT doc_id,
  {_sql_lit(_X.EXTRACT_INSTRUCTIONS + chr(10) + chr(10) + 'Text:' + chr(10))} || text || {_sql_lit(chr(10) + chr(10) + _X.EXTRACT_TAIL)} AS prompt
FROM documents"""
ORACLE["prompt_judge"] = f"""WITH {G}, {RESOLVED}
SELECT source_id, type, target_id,
  {_sql_lit(_X.JUDGE_INSTRUCTIONS + chr(10) + chr(10) + 'Triple: ')} || coalesce(source_name, '?') || ' -[' || type || ']-> '
  || coalesce(target_name, '?') AS prompt
FROM resolved"""

_t = D.utrim("response")
_u = f"trim({_t}, '`')"
_fence = (f"CASE WHEN starts_with({_t}, '```') THEN (CASE WHEN starts_with({_u}, 'json') "
          f"THEN {D.utrim(f'substr({_u}, 5)')} ELSE {_u} END) ELSE {_t} END")
_shape = ('{"models":[{"id":"VARCHAR","name":"VARCHAR","version":"VARCHAR","framework":"VARCHAR","description":"VARCHAR"}],'
          '"experiments":[{"id":"VARCHAR","name":"VARCHAR","status":"VARCHAR"}],'
          '"runs":[{"id":"VARCHAR","name":"VARCHAR","status":"VARCHAR"}],'
          '"deployments":[{"id":"VARCHAR","name":"VARCHAR","cluster":"VARCHAR","image":"VARCHAR","replicas":"BIGINT"}],'
          '"relationships":[{"source_id":"VARCHAR","target_id":"VARCHAR","type":"VARCHAR"}]}')


_INT = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
_NUMERIC = "('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')"


def _fits(field, kind):
    """What the reply schema takes, by the JSON type of ``e.field``."""
    t, text = f"json_type(e, '$.{field}')", f"json_extract_string(e, '$.{field}')"
    if kind == "text":
        return f"{t} = 'VARCHAR'"
    if kind == "optional":
        return f"{t} IN ('VARCHAR', 'NULL')"
    if kind == "count":
        return (f"({t} IN ('UBIGINT', 'BIGINT', 'BOOLEAN') OR ({t} = 'DOUBLE' AND TRY_CAST({text} AS DOUBLE) = floor(TRY_CAST({text} AS DOUBLE)))"
                f" OR ({t} = 'VARCHAR' AND regexp_matches({text}, '{_INT}')))")
    if kind == "values":
        return f"{t} = 'OBJECT'"
    if kind == "numbers":
        return (f"({t} = 'OBJECT' AND coalesce(list_bool_and(list_transform(json_extract(e, '$.{field}.*'), lambda m: json_type(m) IN {_NUMERIC}"
                f" OR (json_type(m) = 'VARCHAR' AND TRY_CAST(json_extract_string(m, '$') AS DOUBLE) IS NOT NULL))), true))")
    return f"({t} IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR ({t} = 'VARCHAR' AND TRY_CAST({text} AS TIMESTAMP) IS NOT NULL))"


def _any(lst, cond):
    return (f"coalesce(list_bool_or(list_transform(CASE WHEN json_type(body, '$.{lst}') = 'ARRAY' THEN json_extract(body, '$.{lst}[*]') END,"
            f" lambda e: {cond})), false)")


def _wrong(lst):
    bad = " OR ".join(f"(json_type(e, '$.{f}') IS NOT NULL AND NOT coalesce({_fits(f, k)}, false))" for f, k in _X.FIELD_KINDS[lst].items())
    element = f"json_type(e) <> 'OBJECT' OR {bad}"
    return f"coalesce(json_type(body, '$.{lst}') <> 'ARRAY', false) OR {_any(lst, element)}"


def _absent(lst):
    return _any(lst, " OR ".join(f"json_type(e, '$.{f}') IS NULL" for f in _X.REQUIRED[lst]))


_LISTS = _X.EXTRACTION.fieldNames()
_sizes = ", ".join(f"CAST(CASE WHEN json_type(body, '$.{k}') = 'ARRAY' THEN json_array_length(body, '$.{k}') ELSE 0 END AS BIGINT) AS n_{k}"
                   for k in _LISTS)
PARSED = f"""r AS ({adapter_sql('responses')}),
s AS (SELECT doc_id, response, {_fence} AS text FROM r),
x AS (SELECT doc_id, response, json_valid(text) AS ok, CASE WHEN json_valid(text) THEN text ELSE 'null' END AS body FROM s),
g AS (SELECT *, json_type(body) = 'OBJECT' AS is_object, from_json(body, '{_shape}') AS j FROM x),
f AS (SELECT *, {" OR ".join(_wrong(k) for k in _LISTS)} AS mistyped, {" OR ".join(_absent(k) for k in _LISTS)} AS absent,
  coalesce(list_bool_or(list_transform(j.models, lambda m: coalesce(contains(lower(m.name), 'flux capacitor'), false))), false) AS deny
  FROM g),
parsed AS (SELECT doc_id,
  CASE WHEN NOT ok THEN 'junk' WHEN NOT is_object OR mistyped OR absent THEN 'invalid' WHEN deny THEN 'rejected' ELSE 'valid' END AS status,
  CASE WHEN NOT ok THEN 'response is not JSON' WHEN NOT is_object THEN 'response is not a JSON object'
       WHEN mistyped THEN 'a field has the wrong type' WHEN absent THEN 'a required field is missing'
       WHEN deny THEN 'denylisted model name' END AS reason,
  CAST(length(response) AS BIGINT) AS response_chars, {_sizes}, response
  FROM f)"""

ORACLE["parse_responses"] = f"WITH {PARSED} SELECT * EXCLUDE (response) FROM parsed"
ORACLE["extraction_counts"] = f"""WITH {PARSED}
SELECT status, count(*) AS responses, CAST(sum(n_models + n_runs + n_deployments) AS BIGINT) AS entity_count,
  CAST(sum(n_relationships) AS BIGINT) AS relationship_count, CAST(sum(response_chars) AS BIGINT) AS response_chars
FROM parsed GROUP BY 1"""
ORACLE["schema_compliance"] = f"""WITH {PARSED}
SELECT count(*) AS responses, count(*) FILTER (WHERE status IN ('valid', 'rejected')) AS compliant,
  round(avg(CASE WHEN status IN ('valid', 'rejected') THEN 1.0 ELSE 0.0 END), 6) AS compliance_rate FROM parsed"""

ORACLE["judge_metrics"] = f"""WITH v AS ({adapter_sql('all_verdicts')})
SELECT type, count(*) AS n, count(*) FILTER (WHERE upper(trim(status)) = 'PASS') AS n_pass,
  count(*) FILTER (WHERE upper(trim(status)) = 'WARN') AS n_warn,
  count(*) FILTER (WHERE upper(trim(status)) = 'FAIL') AS n_fail,
  count(*) FILTER (WHERE upper(trim(status)) NOT IN ('PASS', 'WARN', 'FAIL')) AS n_unknown,
  round(avg(CASE WHEN upper(trim(status)) = 'PASS' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate
FROM v GROUP BY 1"""

ORACLE["hallucination_rate"] = f"""WITH {EDGES}, v AS ({adapter_sql('all_verdicts')}),
w AS (SELECT source_id, type, target_id, bool_or(in_truth) AS in_truth, bool_or(upper(trim(status)) = 'FAIL') AS failed FROM v GROUP BY ALL),
j AS (SELECT NOT coalesce(w.in_truth, false) AS unsup, coalesce(w.failed, false) AS rej
      FROM edges e LEFT JOIN w USING (source_id, type, target_id))
SELECT count(*) AS n_relationships, count(*) FILTER (WHERE unsup) AS n_unsupported,
  count(*) FILTER (WHERE rej) AS n_rejected,
  round(avg(CASE WHEN unsup OR rej THEN 1.0 ELSE 0.0 END), 6) AS hallucination_rate FROM j"""

ORACLE["coverage"] = f"""WITH d AS ({adapter_sql('diseases')}), c AS ({adapter_sql('covers')}),
a AS (SELECT DISTINCT id FROM d), k AS (SELECT DISTINCT id FROM a WHERE id IN (SELECT target_id FROM c))
SELECT (SELECT count(*) FROM a) AS n_total, (SELECT count(*) FROM k) AS n_covered,
  CASE WHEN (SELECT count(*) FROM a) = 0 THEN NULL
       ELSE round((SELECT count(*) FROM k) / (SELECT count(*) FROM a), 6) END AS coverage"""

_terms = ", ".join(f"'{t}'" for t in dict.fromkeys(P.SEARCH_TERMS))
ORACLE["fulltext_lookup"] = f"""WITH t AS (
  SELECT doc_id, CAST(len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
                                                                     lambda w: w <> '')), [{_terms}])) AS BIGINT) AS matched_terms
  FROM documents)
SELECT * FROM t WHERE matched_terms > 0"""

# ---- telemetry ----------------------------------------------------------------------------------------
from newsloom.operators import telemetry as _T  # noqa: E402

_tpl = "CASE " + " ".join(f"WHEN regexp_matches(endpoint, '{p}') THEN '{t}'" for p, t in _T.ROUTE_TEMPLATES) \
       + " ELSE endpoint END"
REQ = f"r AS ({adapter_sql('requests')})"
_bvals = ", ".join(f"({i + 1}, '{repr(float(b))}', CAST({float(b)} AS DOUBLE))" for i, b in enumerate(_T.DEFAULT_BUCKETS))
BUCKETS = f"b AS (SELECT * FROM (VALUES {_bvals}) t(idx, le, v))"

ORACLE["request_counts"] = f"""WITH {REQ}
SELECT method, {_tpl} AS endpoint, coalesce(status, 500) AS status, count(*) AS requests FROM r GROUP BY ALL"""
ORACLE["prediction_errors"] = f"""WITH {REQ}
SELECT {_tpl} AS endpoint, count(*) AS processed, count(*) FILTER (WHERE coalesce(status, 500) >= 500) AS errors
FROM r GROUP BY ALL"""
ORACLE["latency_histogram"] = f"""WITH {REQ}, {BUCKETS},
a AS (SELECT endpoint, round(sum(latency_s), 6) AS latency_sum, count(*) AS latency_count FROM r GROUP BY 1),
k AS (SELECT r.endpoint, b.le, count(*) FILTER (WHERE r.latency_s <= b.v) AS bucket_count FROM r CROSS JOIN b GROUP BY 1, 2
      UNION ALL SELECT endpoint, '+Inf', count(*) FROM r GROUP BY 1)
SELECT a.endpoint, a.latency_sum, a.latency_count, k.le, k.bucket_count FROM a JOIN k USING (endpoint)"""


def _quantile_sql(src: str, key: str, out: str) -> str:
    """histogram_quantile over ``src(key, latency_s)`` grouped by ``key``."""
    q = P.HIST_QUANTILE
    last = float(_T.DEFAULT_BUCKETS[-1])
    return f"""
c AS (SELECT s.{key}, b.idx, b.v AS le, count(*) FILTER (WHERE s.latency_s <= b.v) AS cum FROM {src} s CROSS JOIN b GROUP BY ALL),
t AS (SELECT {key}, count(*) AS total FROM {src} GROUP BY 1),
l AS (SELECT c.*, t.total, {q} * t.total AS rnk,
        coalesce(lag(le) OVER (PARTITION BY c.{key} ORDER BY idx), 0) AS prev_le,
        coalesce(lag(cum) OVER (PARTITION BY c.{key} ORDER BY idx), 0) AS prev_cum
      FROM c JOIN t USING ({key})),
f AS (SELECT {key}, min(idx) FILTER (WHERE cum >= rnk) AS fidx, max(total) AS total FROM l GROUP BY 1),
qq AS (SELECT f.{key}, round(CASE WHEN f.total <= 0 THEN NULL WHEN f.fidx IS NULL THEN {last}
  ELSE (CASE WHEN l.cum - l.prev_cum > 0 THEN l.prev_le + (l.le - l.prev_le) * ((l.rnk - l.prev_cum) / (l.cum - l.prev_cum))
             ELSE l.prev_le END) END, 6) AS {out}
FROM f LEFT JOIN l ON l.{key} = f.{key} AND l.idx = f.fidx)"""


ORACLE["latency_p95"] = f"WITH {REQ}, {BUCKETS}, {_quantile_sql('r', 'endpoint', 'p95')} SELECT * FROM qq"
_WIN = "wr AS (SELECT time_bucket(INTERVAL 1 minute, ts) - k * INTERVAL 1 minute AS window_start, latency_s FROM r, range(0, 5) t(k))"
ORACLE["latency_p95_windows"] = f"""WITH {REQ}, {BUCKETS}, {_WIN}, {_quantile_sql('wr', 'window_start', 'p95')}
SELECT window_start, window_start + INTERVAL 5 minute AS window_end, p95 FROM qq"""

ORACLE["request_rate"] = f"""WITH {REQ},
w AS (SELECT time_bucket(INTERVAL 1 minute, ts) - k * INTERVAL 1 minute AS window_start, endpoint FROM r, range(0, 5) t(k))
SELECT window_start, window_start + INTERVAL 5 minute AS window_end, endpoint, count(*) AS requests,
  round(count(*) / 300.0, 9) AS rate FROM w GROUP BY ALL"""
ORACLE["error_rate"] = f"""WITH {REQ},
w AS (SELECT time_bucket(INTERVAL 1 minute, ts) - k * INTERVAL 1 minute AS window_start FROM r, range(0, 5) t(k)
      WHERE regexp_full_match(CAST(status AS VARCHAR), '5..'))
SELECT window_start, window_start + INTERVAL 5 minute AS window_end, count(*) AS requests,
  round(count(*) / 300.0, 9) AS rate FROM w GROUP BY ALL"""
ORACLE["counter_rate"] = f"""WITH c AS ({adapter_sql('counters')}),
l AS (SELECT *, lag(value) OVER (PARTITION BY endpoint ORDER BY ts, event_id) AS prev FROM c),
i AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS inc FROM l)
SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, endpoint, CAST(sum(inc) AS BIGINT) AS increase,
  round(sum(inc) / 3600.0, 9) AS rate FROM i GROUP BY ALL"""
ORACLE["last_up"] = f"""WITH u AS ({adapter_sql('up')})
SELECT job, up, last_ts FROM (
  SELECT job, up, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rn,
    max(ts) OVER (PARTITION BY job) AS last_ts FROM u WHERE up IS NOT NULL) WHERE rn = 1"""
ORACLE["dashboard_range"] = f"""WITH {REQ}
SELECT endpoint, status, count(*) AS requests FROM r
WHERE ts >= {D.ts(P.DASHBOARD_NOW)} - INTERVAL {P.DASHBOARD_HOURS} HOUR AND ts <= {D.ts(P.DASHBOARD_NOW)} GROUP BY ALL"""

# ---- data quality and audit ---------------------------------------------------------------------------
from newsloom.operators import quality as _Q  # noqa: E402


def _tests_sql(src: str, model: str, tests: dict) -> list[str]:
    out = []
    for c, ts in tests.items():
        if "not_null" in ts:
            out.append(f"SELECT '{model}' AS model, '{c}' AS \"column\", 'not_null' AS test, "
                       f"count(*) FILTER (WHERE {c} IS NULL) AS failures FROM {src}")
        if "unique" in ts:
            out.append(f"SELECT '{model}', '{c}', 'unique', (SELECT count(*) FROM (SELECT {c} FROM {src} "
                       f"WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))")
    return out


_suite = (_tests_sql("raw", "news_articles_raw", _Q.SOURCE_TESTS) + _tests_sql("stg", "stg_news_articles", _Q.STAGING_TESTS)
          + _tests_sql("mart", "fct_daily_article_counts", _Q.MART_TESTS)
          + ["SELECT 'nodes', 'label,id', 'unique', (SELECT count(*) FROM (SELECT label, id FROM nodes "
             "WHERE label IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1))",
             "SELECT 'edges', 'source_id,target_id', 'relationships', (SELECT count(*) FROM (SELECT DISTINCT source_id, "
             "target_id, type FROM edges WHERE source_id NOT IN (SELECT id FROM nodes) "
             "OR target_id NOT IN (SELECT id FROM nodes)))"])
ORACLE["dq_suite"] = f"""WITH {RAW}, {STG}, mart AS ({MART}), {G},
s AS ({' UNION ALL '.join(_suite)})
SELECT model, "column", test, CAST(failures AS BIGINT) AS failures,
  CASE WHEN failures > 0 THEN 'fail' ELSE 'pass' END AS status FROM s"""

ORACLE["dq_freshness"] = f"""WITH {RAW}, m AS (SELECT max(fetched_at) AS max_loaded_at FROM raw)
SELECT 'news_articles_raw' AS source, max_loaded_at,
  round((epoch_us({D.ts(P.FRESHNESS_AS_OF)}) - epoch_us(max_loaded_at)) / 3.6e9, 6) AS age_hours,
  CASE WHEN max_loaded_at IS NULL THEN 'error'
       WHEN (epoch_us({D.ts(P.FRESHNESS_AS_OF)}) - epoch_us(max_loaded_at)) / 3.6e9 > {_Q.FRESHNESS_ERROR_HOURS} THEN 'error'
       WHEN (epoch_us({D.ts(P.FRESHNESS_AS_OF)}) - epoch_us(max_loaded_at)) / 3.6e9 > {_Q.FRESHNESS_WARN_HOURS} THEN 'warn'
       ELSE 'pass' END AS status FROM m"""

ORACLE["dq_ranges"] = f"""WITH runs AS ({adapter_sql('runs')}), {REQ}
SELECT 'runs' AS "table", count(*) AS "rows", 'accuracy' AS "column", CAST(0.0 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi,
  count(*) FILTER (WHERE accuracy < 0.0 OR accuracy > 1.0) AS violations FROM runs
UNION ALL SELECT 'requests', count(*), 'latency_s', 0.0, NULL, count(*) FILTER (WHERE latency_s < 0.0) FROM r
UNION ALL SELECT 'requests', count(*), 'status', 100.0, 599.0, count(*) FILTER (WHERE status < 100 OR status > 599) FROM r
UNION ALL SELECT 'documents', count(*), 'n_chars', 1.0, NULL, count(*) FILTER (WHERE n_chars < 1) FROM documents"""

ORACLE["audit_report"] = f"""WITH a AS ({adapter_sql('audit')}),
g AS (SELECT pipeline, stage, count(*) AS events, count(*) FILTER (WHERE status = 'failed') AS failures,
        count(*) FILTER (WHERE status = 'success') AS successes, max(ts) AS last_ts FROM a GROUP BY 1, 2),
l AS (SELECT pipeline, stage, status AS last_status FROM (
        SELECT *, row_number() OVER (PARTITION BY pipeline, stage ORDER BY ts DESC, status DESC) AS rn FROM a) WHERE rn = 1)
SELECT g.*, l.last_status FROM g JOIN l USING (pipeline, stage)"""

ORACLE["run_log_pivot"] = f"""WITH runs AS ({adapter_sql('runs')})
SELECT run_id, round(accuracy, 6) AS accuracy, round(1.0 - accuracy, 6) AS loss FROM runs"""

# ---- machine learning, chat, streaming ------------------------------------------------------------------
ORACLE["ml_gate"] = f"""WITH runs AS ({adapter_sql('runs')}),
b AS (SELECT * FROM runs ORDER BY accuracy DESC, run_id LIMIT 1)
SELECT b.run_id, round(b.accuracy, 6) AS accuracy, (SELECT count(*) FROM runs) AS n_runs,
  (SELECT count(*) FROM runs WHERE accuracy >= {P.ACCURACY_GATE}) AS n_passing,
  CASE WHEN b.accuracy >= {P.ACCURACY_GATE} THEN 'register_model' ELSE 'notify_training_failure' END AS next_task,
  'v' || strftime(b.finished_at, '%Y%m%d%H%M%S') AS model_version FROM b"""

_role = "CASE WHEN lower(role) IN ('ai', 'assistant') THEN 'assistant' ELSE 'user' END"
ORACLE["transcripts"] = f"""SELECT conv_id, string_agg({_role} || ': ' || text, chr(10) ORDER BY turn) AS transcript,
  count({_role} || ': ' || text) AS n_turns FROM conversations GROUP BY 1"""
ORACLE["last_message"] = f"""SELECT conv_id, turn AS last_turn, {_role} AS last_role, CAST(length(text) AS BIGINT) AS last_chars,
  'end' AS next_step FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn = 1"""

ORACLE["stream_ingest"] = ORACLE["processed_articles"]
ORACLE["stream_daily_counts"] = ORACLE["daily_counts"]
ORACLE["stream_raw_epochs"] = ORACLE["processed_articles"]
ORACLE["stream_dedup"] = f"WITH {RAW_ITEMS} SELECT DISTINCT article_id, published_at FROM raw"
ORACLE["stream_request_rate"] = ORACLE["request_rate"]
ORACLE["stream_error_rate"] = ORACLE["error_rate"]
ORACLE["stream_latency_p95"] = ORACLE["latency_p95_windows"]
ORACLE["stream_audit"] = ORACLE["audit_report"]

ORACLE["elt_daily_counts"] = f"""WITH {RAW}, p AS ({elt_sql('raw')})
SELECT published_date, source_name, count(*) AS article_count,
  count(*) FILTER (WHERE content_length > 0) AS sentiment_ready_count FROM p GROUP BY 1, 2"""
ORACLE["extracted_entities"] = f"""WITH {PARSED.replace("parsed AS (SELECT doc_id,", "parsed AS (SELECT doc_id, j,")}
SELECT doc_id, m.id AS id, m.name AS name, m.version AS version
FROM (SELECT doc_id, unnest(j.models) AS m FROM parsed WHERE status = 'valid') WHERE m.id IS NOT NULL"""
ORACLE["graph_labels"] = f"""WITH {NODES}
SELECT label, count(*) AS node_count, count(name) AS with_name, count(a1) AS with_a1, count(a2) AS with_a2
FROM nodes GROUP BY 1"""

ORACLE["ml_split"] = f"""SELECT vec_id, label,
  CASE WHEN CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM embeddings"""

from newsloom.sources.landing import RAW_SCHEMA as _RAW_SCHEMA  # noqa: E402

_REQUIRED = ("article_id", "title", "url", "published_at", "batch_id")
_meta = " UNION ALL ".join(
    f"SELECT 'news_articles_raw' AS \"table\", '{f.name}' AS \"column\", '{f.dataType.simpleString()}' AS expected, "
    f"'{f.dataType.simpleString()}' AS actual, 'ok' AS issue" for f in _RAW_SCHEMA.fields)
_nulls = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM raw"
                            for c in _REQUIRED)
ORACLE["dq_schema"] = f"""WITH {RAW}, meta AS ({_meta}), n AS ({_nulls})
SELECT m."table", m."column", m.expected, m.actual, m.issue, n.null_count FROM meta m LEFT JOIN n USING ("column")"""

ORACLE["kg_ingest"] = f"""WITH {PARSED.replace("parsed AS (SELECT doc_id,", "parsed AS (SELECT doc_id, j,")}, {G},
valid AS (SELECT doc_id, j FROM parsed WHERE status = 'valid'),
nb AS (
  SELECT 'Model' AS label, m.id AS id, doc_id FROM (SELECT doc_id, unnest(j.models) AS m FROM valid) WHERE m.id IS NOT NULL
  UNION ALL SELECT 'Run', r.id, doc_id FROM (SELECT doc_id, unnest(j.runs) AS r FROM valid) WHERE r.id IS NOT NULL
  UNION ALL SELECT 'Experiment', e.id, doc_id FROM (SELECT doc_id, unnest(j.experiments) AS e FROM valid) WHERE e.id IS NOT NULL
  UNION ALL SELECT 'Deployment', p.id, doc_id FROM (SELECT doc_id, unnest(j.deployments) AS p FROM valid) WHERE p.id IS NOT NULL),
nodes2 AS (SELECT label, id FROM nodes UNION SELECT label, id FROM nb),
eb AS (SELECT x.source_id, x.target_id, x.type FROM (SELECT unnest(j.relationships) AS x FROM valid) WHERE x.source_id IS NOT NULL),
ids AS (SELECT DISTINCT id FROM nodes2),
eb2 AS (SELECT DISTINCT * FROM eb WHERE source_id IN (SELECT id FROM ids) AND target_id IN (SELECT id FROM ids)),
edges2 AS (SELECT DISTINCT source_id, target_id, type FROM (SELECT source_id, target_id, type FROM edges UNION ALL SELECT * FROM eb2))
SELECT 'node' AS kind, label AS name, count(*) AS n,
  count(*) FILTER (WHERE (label, id) IN (SELECT (label, id) FROM nb)) AS touched FROM nodes2 GROUP BY 1, 2
UNION ALL
SELECT 'edge', type, count(*), count(*) FILTER (WHERE (source_id, target_id, type) IN (SELECT (source_id, target_id, type) FROM eb2))
FROM edges2 GROUP BY 1, 2"""
ORACLE["fulltext_index"] = ORACLE["fulltext_lookup"]
ORACLE["node_upsert_bucketed"] = ORACLE["node_upsert"]

ORACLE["raw_table"] = f"""WITH {RAW}
SELECT article_id, title, source_name, description, content, url, published_at, fetched_at, query, language, batch_id FROM raw"""
ORACLE["landed_items"] = f"""WITH items AS ({adapter_sql('items')})
SELECT source_name, title, url, published_at_text, author, description, content FROM items"""
ORACLE["corrupt_lines"] = """SELECT CAST(doc_id AS VARCHAR) AS article_id, text AS content, NULL AS line FROM documents
UNION ALL SELECT NULL, NULL, 'broken {' || doc_id FROM documents WHERE doc_id % 9 = 0"""
ORACLE["mark_read"] = f"""SELECT 'click' AS name, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS stored,
  date_trunc('second', max(ts)) AS since, 'stored' AS mark_source FROM events WHERE event_type = 'click'
UNION ALL SELECT 'signup', '12:30', {D.ts(P.AS_OF)} - INTERVAL 24 HOUR, 'invalid_stored'
UNION ALL SELECT 'absent', NULL, {D.ts(P.AS_OF)} - INTERVAL 24 HOUR, 'lookback'"""
ORACLE["required_columns"] = f"""WITH {RAW},
r AS (SELECT concat_ws(',', CASE WHEN article_id IS NULL THEN 'article_id' END, CASE WHEN title IS NULL THEN 'title' END,
  CASE WHEN content IS NULL THEN 'content' END) AS m FROM raw)
SELECT CASE WHEN m = '' THEN 'ok' ELSE 'missing required: ' || m END AS reason, count(*) AS n FROM r GROUP BY 1"""
ORACLE["quarantine_artifact"] = f"""WITH {PARSED} SELECT doc_id, status, reason, response FROM parsed WHERE status <> 'valid'"""
_reply_body = _fence.replace("response", "reply")
ORACLE["judge_verdicts"] = f"""WITH r AS ({adapter_sql('judge_replies')}),
b AS (SELECT source_id, target_id, {_reply_body} AS body FROM r),
v AS (SELECT *, CASE WHEN json_valid(body) THEN upper(trim(json_extract_string(body, '$.status'))) END AS st,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.reasoning') END AS reasoning,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.suggested_correction') END AS suggested_correction FROM b)
SELECT source_id, target_id, CASE WHEN st IN ('PASS', 'FAIL', 'WARN') THEN st END AS status, reasoning, suggested_correction FROM v"""
ORACLE["unsupported_edges"] = f"""WITH {EDGES}, v AS ({adapter_sql('verdicts')})
SELECT source_id, target_id, type FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM v WHERE in_truth AND v.source_id = e.source_id AND v.target_id = e.target_id AND v.type = e.type)"""
ORACLE["lineage_paths"] = f"""WITH {G},
serves AS (SELECT * FROM {_typed('SERVES', 'Deployment', 'Model', 'deployment_id', 'model_id')}),
produced AS (SELECT * FROM {_typed('PRODUCED_BY', 'Model', 'Run', 'model_id', 'run_id')}),
belongs AS (SELECT * FROM {_typed('BELONGS_TO', 'Run', 'Experiment', 'run_id', 'experiment_id')})
SELECT deployment_id, model_id, run_id, experiment_id FROM serves JOIN produced USING (model_id) JOIN belongs USING (run_id)
WHERE deployment_id = '{P.LINEAGE_DEPLOYMENT}'"""
ORACLE["node_properties"] = f"""WITH {PARSED.replace("parsed AS (SELECT doc_id,", "parsed AS (SELECT doc_id, j, body,")},
valid AS (SELECT doc_id, j, body FROM parsed WHERE status = 'valid'),
runs AS (SELECT doc_id, unnest(json_extract(body, '$.runs[*]')) AS e FROM valid),
n AS (
SELECT 'Model' AS label, m.id AS id, m.name AS name, m.version AS a1, coalesce(m.framework, 'pytorch') AS a2,
  m.description AS description, NULL AS image, CAST(NULL AS BIGINT) AS replicas, CAST(NULL AS DOUBLE) AS accuracy,
  CAST(NULL AS INTEGER) AS n_parameters, doc_id FROM (SELECT doc_id, unnest(j.models) AS m FROM valid)
UNION ALL SELECT 'Experiment', e.id, e.name, coalesce(e.status, 'active'), NULL, NULL, NULL, NULL, NULL, NULL, doc_id
  FROM (SELECT doc_id, unnest(j.experiments) AS e FROM valid)
UNION ALL SELECT 'Run', json_extract_string(e, '$.id'), json_extract_string(e, '$.name'), coalesce(json_extract_string(e, '$.status'), 'completed'),
  NULL, NULL, NULL, NULL, CASE json_type(json_extract(e, '$.metrics.*')[1]) WHEN 'BOOLEAN' THEN
    CASE WHEN json_extract_string(json_extract(e, '$.metrics.*')[1], '$') = 'true' THEN 1.0 ELSE 0.0 END
    ELSE TRY_CAST(json_extract_string(json_extract(e, '$.metrics.*')[1], '$') AS DOUBLE) END,
  CAST(coalesce(len(json_keys(e, '$.parameters')), 0) AS INTEGER), doc_id FROM runs
UNION ALL SELECT 'Deployment', p.id, p.name, coalesce(p.cluster, 'local-k8s'), NULL, NULL, p.image, coalesce(p.replicas, 1), NULL, NULL, doc_id
  FROM (SELECT doc_id, unnest(j.deployments) AS p FROM valid))
SELECT * EXCLUDE (doc_id) FROM n QUALIFY row_number() OVER (PARTITION BY label, id ORDER BY doc_id DESC) = 1"""

ORACLE["ml_scored"] = f"""SELECT vec_id, label, 'v20240202000000' AS model_version, true AS in_domain
FROM ({ORACLE["ml_split"]}) WHERE split = 'test'"""

ORACLE["malformed_items"] = f"""WITH items AS ({adapter_sql('items')})
SELECT item_ord, published_at_text, 'unparseable publishedAt' AS reason FROM items
WHERE NULLIF(trim(published_at_text), '') IS NOT NULL AND NOT regexp_matches(trim(published_at_text), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')"""
ORACLE["gate_each_run"] = f"""WITH runs AS ({adapter_sql('checked_runs')})
SELECT CASE WHEN accuracy >= {P.ACCURACY_GATE} AND NOT isnan(accuracy) THEN 'register_model' ELSE 'notify_training_failure' END AS next_task,
  count(*) AS n FROM runs GROUP BY 1"""
ORACLE["without_batch"] = f"WITH {RAW} SELECT article_id, title, content, batch_id FROM raw WHERE batch_id IS DISTINCT FROM 'batch_2'"
ORACLE["append_messages"] = "SELECT conv_id, turn, role, text FROM conversations"

ORACLE["newest_first"] = f"WITH {RAW_ITEMS} SELECT item_ord, article_id, published_at, title FROM raw"
ORACLE["retention_job"] = ORACLE["retention_filter"]
ORACLE["upsert_rows"] = f"""WITH {RAW}
SELECT article_id, title, content, batch_id FROM raw WHERE batch_id = 'batch_2'
UNION ALL SELECT article_id, title, content, batch_id FROM raw r WHERE batch_id = 'batch_1'
  AND NOT EXISTS (SELECT 1 FROM raw s WHERE s.batch_id = 'batch_2' AND s.article_id = r.article_id)"""
ORACLE["upsert_compacted"] = f"SELECT *, 'v000000000002' AS version FROM ({ORACLE['elt_upsert']})"

ORACLE["graph_properties"] = f"""WITH nodes AS ({adapter_sql('open_nodes')}),
p AS (SELECT label, unnest(['name', 'a1', 'a2']) AS property, unnest([name, a1, a2]) AS v, 'STRING' AS type FROM nodes
  UNION ALL SELECT label, property, CAST(json_extract(props_text, '$.' || property) AS VARCHAR),
    CASE property WHEN 'size' THEN 'BIGINT' WHEN 'replicas' THEN 'BIGINT' WHEN 'tags' THEN 'ARRAY<STRING>' WHEN 'canary' THEN 'BOOLEAN'
      WHEN 'metrics' THEN 'OBJECT<accuracy: BIGINT>' WHEN 'parameters' THEN 'OBJECT<user: STRING>' ELSE 'STRING' END
  FROM (SELECT label, props_text, unnest(json_keys(props_text)) AS property FROM nodes)
  WHERE json_type(props_text, '$.' || property) <> 'NULL')
SELECT label, property, count(*) AS nodes, any_value(type) AS type FROM p WHERE v IS NOT NULL GROUP BY 1, 2"""

_PAGES = f"""i AS ({adapter_sql('paged_items')}),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id, page ORDER BY item_ord) - 1 AS pos,
  TRY_CAST(NULLIF(trim(published_at_text), '') AS TIMESTAMP) AS published_at FROM i)"""
ORACLE["source_pages"] = f"""WITH {_PAGES},
pages AS (SELECT run_id, page, count(*) AS n, min(pos) FILTER (WHERE published_at <= {D.ts(P.PAGE_SINCE)}) AS old_at FROM t GROUP BY 1, 2
  UNION ALL SELECT DISTINCT run_id, 2, 0, NULL FROM t WHERE CAST(regexp_extract(run_id, '([0-9]+)', 1) AS BIGINT) % 5 = 2),
walk AS (SELECT *, row_number() OVER w = page AS whole, coalesce(bool_or(n < {P.PAGE_ITEMS} OR old_at IS NOT NULL)
    OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped
  FROM pages WHERE page <= 5 WINDOW w AS (PARTITION BY run_id ORDER BY page))
SELECT t.run_id, t.page, CAST(pos AS INTEGER) AS pos, source_name, title, url, published_at_text, author, description, content,
  'img-' || item_ord AS image
FROM t JOIN walk w ON t.run_id = w.run_id AND t.page = w.page WHERE whole AND NOT stopped AND (old_at IS NULL OR pos < old_at)"""
ORACLE["raw_payloads"] = f"""WITH {RAW_ITEMS}
SELECT r.article_id, i.title, i.url, i.published_at_text, i.source_name, i.content, 'img-' || i.item_ord AS image
FROM raw r JOIN items i ON r.item_ord = i.item_ord"""

_fields = "(SELECT doc_id, 'title' AS field, 2.0 AS weight, split_part(text, chr(10), 1) AS body FROM documents UNION ALL SELECT doc_id, 'text', 1.0, text FROM documents)"
ORACLE["fulltext_ranked"] = f"""WITH w AS (SELECT doc_id, field, weight, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> '') AS words FROM {_fields}),
f AS (SELECT field, count(*) AS documents, avg(len(words)) AS mean_length FROM w WHERE len(words) > 0 GROUP BY 1),
h AS (SELECT doc_id, field, weight, len(words) AS length, term, len(list_filter(words, lambda x: x = term)) AS tf
  FROM w, (SELECT unnest([{", ".join(f"'{t}'" for t in P.RANKED_TERMS)}]) AS term)),
p AS (SELECT * FROM h WHERE tf > 0), n AS (SELECT term, field, count(*) AS n FROM p GROUP BY 1, 2)
SELECT doc_id, round(sum(weight * ln(1 + (documents - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
FROM p JOIN n USING (term, field) JOIN f USING (field) GROUP BY doc_id ORDER BY sum(weight * ln(1 + (documents - n + 0.5) / (n + 0.5)) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) DESC, doc_id LIMIT {P.RANKED_K}"""

ORACLE["run_report"] = f"""WITH a AS (SELECT *, CAST(ts AS TIMESTAMP) AS t FROM ({adapter_sql('audit')})),
g AS (SELECT *, coalesce(epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY pipeline ORDER BY t) > {P.RUN_GAP_SECONDS} * 1000000, true) AS starts FROM a),
r AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY pipeline ORDER BY t ROWS UNBOUNDED PRECEDING) AS run_no FROM g),
s AS (SELECT pipeline, run_no, stage, min(t) AS first FROM r GROUP BY 1, 2, 3),
o AS (SELECT pipeline, run_no, string_agg(stage, '>' ORDER BY first, stage) AS stages FROM s GROUP BY 1, 2),
k AS (SELECT pipeline, run_no, arg_min(stage, (t, stage)) FILTER (WHERE status = 'failed') AS first_failed_stage, min(t) AS run_start, max(t) AS run_end,
    count(*) AS events, count(*) FILTER (WHERE status = 'failed') AS failures FROM r GROUP BY 1, 2),
z AS (SELECT *, coalesce(max(CASE WHEN failures = 0 THEN run_no END) OVER (PARTITION BY pipeline ORDER BY run_no ROWS UNBOUNDED PRECEDING), 0) AS good FROM k)
SELECT z.pipeline, CAST(z.run_no AS BIGINT) AS run_no, run_start, run_end, (epoch_us(run_end) - epoch_us(run_start)) / 1000000 AS seconds, events, failures,
  stages, first_failed_stage, CAST(z.run_no - good AS BIGINT) AS failing_runs FROM z JOIN o USING (pipeline, run_no)"""
ORACLE["run_log_texts"] = f"""WITH runs AS ({adapter_sql('runs')})
SELECT run_id, '{P.ACCURACY_GATE}' AS gate, 'run ' || run_id AS note FROM runs"""
ORACLE["load_branch"] = f"""WITH {RAW}
SELECT b AS batch_id, CASE WHEN EXISTS (SELECT 1 FROM raw WHERE batch_id = b) THEN 'load' ELSE 'skip' END AS next_task
FROM (SELECT unnest(['batch_1', 'batch_2', 'batch_9']) AS b)"""
ORACLE["ml_evaluate"] = """SELECT count(*) AS processed, round(avg(CASE WHEN CAST(length(text) > 500 AS INTEGER) = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL"""

_stage_nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ("article_id", "title", "source_name", "url", "published_at", "batch_id"))
ORACLE["model_gate"] = f"""WITH {RAW},
f AS (SELECT CAST((SELECT {_stage_nulls} FROM raw) + (SELECT count(*) FROM (SELECT article_id FROM raw WHERE article_id IS NOT NULL
  GROUP BY 1 HAVING count(*) > 1)) AS BIGINT) AS n)
SELECT 'stg_news_articles' AS model, 'fail' AS status, n AS failures, NULL AS blocked_by FROM f
UNION ALL SELECT 'fct_daily_article_counts', 'skipped', NULL, 'stg_news_articles'
UNION ALL SELECT 'mart_sources', 'skipped', NULL, 'stg_news_articles'
UNION ALL SELECT 'required_rows', 'pass', 0, NULL UNION ALL SELECT 'required_sources', 'pass', 0, NULL"""
ORACLE["fct_incremental"] = ORACLE["fct_daily_counts"]
ORACLE["processed_table"] = f"""WITH {RAW}, p AS ({elt_sql('raw')})
SELECT published_date, source_name, count(*) AS article_count, count(*) FILTER (WHERE content_length > 0) AS sentiment_ready_count,
  CAST(sum(content_length) AS BIGINT) AS characters FROM p GROUP BY 1, 2"""

_valid = PARSED.replace("parsed AS (SELECT doc_id,", "parsed AS (SELECT doc_id, j, body,")
ORACLE["extracted_rows"] = f"""WITH {_valid},
valid AS (SELECT doc_id, j, body FROM parsed WHERE status = 'valid'),
runs AS (SELECT doc_id, unnest(json_extract(body, '$.runs[*]')) AS e FROM valid)
SELECT doc_id, 'models' AS kind, m.id AS id, m.name AS name, m.version AS value FROM (SELECT doc_id, unnest(j.models) AS m FROM valid)
UNION ALL SELECT doc_id, 'experiments', e.id, e.name, e.status FROM (SELECT doc_id, unnest(j.experiments) AS e FROM valid)
UNION ALL SELECT doc_id, 'runs', json_extract_string(e, '$.id'), json_extract_string(e, '$.name'), json_extract_string(e, '$.metrics.accuracy') FROM runs
UNION ALL SELECT doc_id, 'deployments', p.id, p.name, CAST(p.replicas AS VARCHAR) FROM (SELECT doc_id, unnest(j.deployments) AS p FROM valid)
UNION ALL SELECT doc_id, 'relationships', x.source_id, x.target_id, x.type FROM (SELECT doc_id, unnest(j.relationships) AS x FROM valid)"""
ORACLE["next_step"] = ORACLE["last_message"].replace("'end' AS next_step",
    "CASE WHEN len(regexp_extract_all(text, '[A-Z][a-z]+ble')) > 0 THEN 'continue' ELSE 'end' END AS next_step")
ORACLE["raw_appended"] = f"WITH {RAW} SELECT article_id, title, content, url, batch_id FROM raw"
ORACLE["configured_items"] = f"""WITH {RAW_ITEMS}
SELECT article_id, source_name, language, title FROM raw
WHERE source_name IN ('src1', 'src3', 'src5') AND language = '{P.LANGUAGE}' AND ({_kw_pred})"""
