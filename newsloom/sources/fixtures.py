"""Adapters from the given tables to the inputs of the operators.

Each adapter is one SELECT over the given tables that injects the NULLs, blanks, padding,
duplicates, junk and dangling keys the operators must handle. The text is written so that it
runs unchanged in Spark SQL and in the DuckDB oracle; ``{table}`` placeholders are bound to
DataFrames in Spark (``spark.sql(text, documents=df)``) and to view names in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources.tables import read_table

# Every document is an item with its whole text; a second run brings every tenth again, and faulty items are extra rows.
ITEMS = """
WITH base AS (
  SELECT doc_id, 0 AS copy, text, lang, source FROM {documents}
  UNION ALL
  SELECT doc_id, 1, text || ' (again)', lang, source FROM {documents} WHERE doc_id % 10 = 0
  UNION ALL
  SELECT doc_id, 2, text, lang, source FROM {documents}
  WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0
     OR doc_id % 29 = 0 OR doc_id % 37 = 0)
SELECT doc_id * 3 + copy AS item_ord,
  CASE WHEN copy = 2 AND doc_id % 17 = 0 THEN NULL ELSE '  ' || source || ' ' END AS source_name,
  CASE WHEN copy = 2 AND doc_id % 19 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
  CASE WHEN copy = 2 AND doc_id % 23 = 0 THEN ''
       ELSE 'https://example.com/' || source || '/' || CAST(doc_id AS STRING) END AS url,
  CASE WHEN copy = 2 AND doc_id % 29 = 0 THEN NULL WHEN copy = 2 AND doc_id % 37 = 0 THEN '12:30'
       ELSE '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(doc_id % 24 AS STRING), 2, '0')
            || CASE WHEN doc_id % 4 = 0 THEN ':00:00.120Z' ELSE ':00:00Z' END END AS published_at_text,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS author,
  CASE WHEN copy = 2 AND doc_id % 5 = 0 THEN NULL ELSE text END AS description,
  CASE WHEN copy < 2 THEN text WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ''
       WHEN doc_id % 13 = 0 THEN '   ' ELSE text END AS content,
  lang AS language,
  CASE WHEN copy = 1 THEN 'scheduled__2024-02-02T00:00:00+00:00'
       ELSE 'scheduled__2024-02-01T00:00:00+00:00' END AS run_id
FROM base
"""

RAW_LANDED = """
WITH base AS (
  SELECT doc_id, 0 AS copy, text, lang, source, 1 AS b FROM {documents}
  UNION ALL
  SELECT doc_id, 1, text || ' (v2)', lang, source, 2 FROM {documents} WHERE doc_id % 10 = 0
  UNION ALL
  SELECT doc_id, 2, text, lang, source, 1 FROM {documents}
  WHERE doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 19 = 0 OR doc_id % 31 = 0)
SELECT CASE WHEN copy < 2 THEN 'a' || CAST(doc_id AS STRING) WHEN doc_id % 31 = 0 THEN NULL
            ELSE 'f' || CAST(doc_id AS STRING) END AS article_id,
  CASE WHEN copy = 2 AND doc_id % 19 = 0 THEN NULL ELSE ' ' || split_part(text, chr(10), 1) || ' ' END AS title,
  ' ' || source AS source_name,
  CASE WHEN copy < 2 THEN ' ' || text || ' ' WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ''
       WHEN doc_id % 13 = 0 THEN '   ' ELSE ' ' || text || ' ' END AS content,
  CASE WHEN copy = 2 AND doc_id % 5 = 0 THEN NULL ELSE text END AS description,
  'https://example.com/' || CAST(doc_id AS STRING) AS url,
  '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || ' 10:00:00' AS published_at_text,
  '2024-02-0' || CAST(b AS STRING) || ' 00:00:00' AS fetched_at_text,
  'q' AS query, 'batch_' || CAST(b AS STRING) AS batch_id, lang AS language
FROM base
"""

NODES = """
SELECT 'model_' || CAST(p_partkey AS STRING) AS id, 'Model' AS label, p_name AS name, p_brand AS a1, p_type AS a2 FROM {part}
UNION ALL SELECT 'run_' || CAST(o_orderkey AS STRING), 'Run', o_orderpriority, o_orderstatus, NULL FROM {orders}
UNION ALL SELECT 'exp_' || CAST(c_custkey AS STRING), 'Experiment', c_name, c_mktsegment, NULL FROM {customer}
UNION ALL SELECT 'dep_' || CAST(s_suppkey AS STRING), 'Deployment', s_name, 'cluster_' || CAST(s_nationkey AS STRING), NULL FROM {supplier}
"""

EDGES = """
SELECT DISTINCT 'model_' || CAST(l_partkey AS STRING) AS source_id,
  CASE WHEN l_orderkey % 97 = 0 THEN 'run_missing_' ELSE 'run_' END || CAST(l_orderkey AS STRING) AS target_id,
  'PRODUCED_BY' AS type FROM {lineitem}
UNION ALL SELECT DISTINCT 'dep_' || CAST(l_suppkey AS STRING), 'model_' || CAST(l_partkey AS STRING), 'SERVES' FROM {lineitem}
UNION ALL SELECT 'run_' || CAST(o_orderkey AS STRING), 'exp_' || CAST(o_custkey AS STRING), 'BELONGS_TO' FROM {orders}
"""

VERDICTS = """
SELECT 'dep_' || CAST(l_suppkey AS STRING) AS source_id, 'model_' || CAST(l_partkey AS STRING) AS target_id, 'SERVES' AS type,
  CASE WHEN max(l_linenumber) = 7 THEN 'FAIL' WHEN max(l_linenumber) = 6 THEN 'WARN' ELSE 'PASS' END AS status,
  max(l_quantity) > 5 AS in_truth
FROM {lineitem} GROUP BY l_suppkey, l_partkey
"""

# Judge replies about the SERVES edges: fenced JSON in lower case, some with an unknown status, some without JSON.
JUDGE_REPLIES = """
SELECT 'dep_' || CAST(l_suppkey AS STRING) AS source_id, 'model_' || CAST(l_partkey AS STRING) AS target_id,
  CASE WHEN l_partkey % 13 = 0 THEN 'cannot say'
       ELSE CASE WHEN l_partkey % 2 = 0 THEN '```json' || chr(10) ELSE '' END || '{{"status":"'
         || CASE WHEN l_partkey % 11 = 0 THEN 'maybe' WHEN max(l_linenumber) = 7 THEN 'fail' WHEN max(l_linenumber) = 6 THEN ' Warn '
                 ELSE 'PASS' END
         || '","reasoning":"' || CAST(count(*) AS STRING) || ' lines"'
         || CASE WHEN max(l_linenumber) = 7 THEN ',"suggested_correction":"drop ' || CAST(l_partkey AS STRING) || '"' ELSE '' END || '}}'
         || CASE WHEN l_partkey % 2 = 0 THEN chr(10) || '```' ELSE '' END END AS reply
FROM {lineitem} GROUP BY l_suppkey, l_partkey
"""

# Verdicts about every edge type; every seventh edge has a second verdict, which may disagree.
ALL_VERDICTS = """
WITH first AS (
  SELECT 'dep_' || CAST(l_suppkey AS STRING) AS source_id, 'model_' || CAST(l_partkey AS STRING) AS target_id, 'SERVES' AS type,
    max(l_linenumber) AS a, max(l_partkey) AS b FROM {lineitem} GROUP BY l_suppkey, l_partkey
  UNION ALL
  SELECT 'model_' || CAST(l_partkey AS STRING), 'run_' || CAST(l_orderkey AS STRING), 'PRODUCED_BY', max(l_linenumber), max(l_orderkey)
  FROM {lineitem} GROUP BY l_partkey, l_orderkey
  UNION ALL
  SELECT 'run_' || CAST(o_orderkey AS STRING), 'exp_' || CAST(o_custkey AS STRING), 'BELONGS_TO', o_orderkey % 8, o_custkey FROM {orders})
SELECT source_id, target_id, type, CASE WHEN a = 7 THEN 'FAIL' WHEN a = 6 THEN 'WARN' ELSE 'PASS' END AS status, b % 5 <> 0 AS in_truth FROM first
UNION ALL
SELECT source_id, target_id, type, CASE WHEN b % 2 = 0 THEN 'FAIL' ELSE ' pass ' END, b % 3 = 0 FROM first WHERE b % 7 = 0
"""

# Nodes with an open property set as JSON text: descriptions, metrics, parameters, images and replicas, and keys of no schema.
OPEN_NODES = """
SELECT 'model_' || CAST(p_partkey AS STRING) AS id, 'Model' AS label, p_name AS name, p_brand AS a1, p_type AS a2,
  '{{"description":"' || p_name || ' of type ' || p_type || '","size":' || CAST(p_size AS STRING)
    || CASE WHEN p_partkey % 4 = 0 THEN ',"tags":["a","b"]' WHEN p_partkey % 4 = 1 THEN ',"tags":null' ELSE '' END || '}}' AS props_text FROM {part}
UNION ALL SELECT 'run_' || CAST(o_orderkey AS STRING), 'Run', o_orderpriority, o_orderstatus, NULL,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '{{"metrics":{{"accuracy":' || CAST(o_orderkey % 100 AS STRING) || '}},"parameters":{{"user":"'
    || CAST(o_custkey AS STRING) || '"}}}}' END FROM {orders}
UNION ALL SELECT 'exp_' || CAST(c_custkey AS STRING), 'Experiment', c_name, c_mktsegment, NULL, '{{}}' FROM {customer}
UNION ALL SELECT 'dep_' || CAST(s_suppkey AS STRING), 'Deployment', s_name, 'cluster_' || CAST(s_nationkey AS STRING), NULL,
  '{{"image":"img:' || CAST(s_nationkey AS STRING) || '"' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE ',"replicas":' || CAST(s_suppkey % 7 AS STRING) END
    || CASE WHEN s_suppkey % 6 = 0 THEN ',"canary":true' ELSE '' END || '}}' FROM {supplier}
"""

# The runs, and some whose accuracy is not a number or absent.
CHECKED_RUNS = """
SELECT 'run_' || CAST(o_orderkey AS STRING) AS run_id, CAST(0.75 + (o_orderkey % 25) / 100.0 AS DOUBLE) AS accuracy FROM {orders}
UNION ALL SELECT 'bad_' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN CAST('NaN' AS DOUBLE) END FROM {orders} WHERE o_orderkey % 10 < 2
"""

# Pages of a paged source: 300 item ordinals are a run, 60 a page. Some runs hold an empty page, some lack one.
PAGED_ITEMS = """
WITH i AS (""" + ITEMS + """),
p AS (SELECT *, CAST(floor(item_ord / 300) AS BIGINT) AS r, CAST(floor((item_ord % 300) / 60) AS INT) AS q FROM i)
SELECT item_ord, 'run_' || CAST(r AS STRING) AS run_id,
  CAST(1 + q + CASE WHEN r % 5 = 2 AND q >= 1 THEN 1 WHEN r % 7 = 3 AND q >= 2 THEN 1 ELSE 0 END AS INT) AS page,
  source_name, title, url, published_at_text, author, description, content
FROM p
"""

COVERS = """
SELECT DISTINCT 'lo_' || CAST(l_suppkey AS STRING) AS source_id, 'disease_' || CAST(l_partkey AS STRING) AS target_id
FROM {lineitem} WHERE l_quantity >= 50
"""

DISEASES = """
SELECT 'disease_' || CAST(p_partkey AS STRING) AS id, p_name AS name FROM {part}
"""

# One whole reply per document: the description is its text, escaped for JSON; all five lists occur. Some are fenced, name a
# denylisted model or lack a required field.
WHOLE_REPLIES = """
escaped AS (
  SELECT doc_id, source, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'),
    chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS body FROM {documents}),
parts AS (
  SELECT doc_id, CAST(doc_id AS STRING) AS k,
    '"models":[{{"id":"m' || CAST(doc_id AS STRING) || '","name":"'
      || CASE WHEN doc_id % 31 = 0 THEN 'Flux Capacitor' ELSE 'Net' || CAST(doc_id % 9 AS STRING) END || '"'
      || CASE WHEN doc_id % 17 = 0 THEN '' ELSE ',"version":"v' || CAST(doc_id % 5 AS STRING) || '"' END
      || ',"description":"' || body || '"}}]' AS models,
    '"experiments":[' || CASE WHEN doc_id % 3 = 0 THEN '{{"id":"e' || CAST(doc_id AS STRING) || '","name":"' || source || '"}}'
      ELSE '' END || ']' AS experiments,
    '"deployments":[' || CASE WHEN doc_id % 4 = 0 THEN '{{"id":"d' || CAST(doc_id AS STRING) || '","name":"Serving","image":"img:'
      || CAST(doc_id % 7 AS STRING) || '","replicas":' || CASE WHEN doc_id % 8 = 0 THEN '2' ELSE '"3"' END || '}}' ELSE '' END
      || ']' AS deployments
  FROM escaped),
whole AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '```json' || chr(10) ELSE '' END
    || '{{' || models || ',' || experiments || ',"runs":[{{"id":"r' || k || '","name":"Run","metrics":{{"accuracy":'
    || CASE WHEN doc_id % 5 = 0 THEN '"0.9"' ELSE '0.9' END || '}}}}],' || deployments
    || ',"relationships":[{{"source_id":"m' || k || '","target_id":"r' || k || '","type":"PRODUCED_BY"}}]}}'
    || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '```' ELSE '' END AS response
  FROM parts)"""

# Faulty and unusual replies: a list with one element of the given fields, or a whole text.
_ELEMENT = {"models": '"id":"x","name":"X","version":"v"', "experiments": '"id":"x","name":"X"', "runs": '"id":"x","name":"X"',
            "deployments": '"id":"x","name":"X","image":"i"', "relationships": '"source_id":"x","target_id":"y","type":"SERVES"'}


def _reply(kind: str, *fields: str) -> str:
    return '{"' + kind + '":[{' + ",".join((_ELEMENT[kind], *fields)) + "}]}"


ODD_REPLIES = [
    "no json here", "", "{}", "[]", "5", '"text"', "null", "true", '{"models":"abc"}', '{"models":null}', '{"models":{}}',
    '{"runs":[5]}', '{"runs":[null]}', '{"models":[{"id":5,"name":"X","version":"v"}]}', '{"models":[{"id":"x","name":true,"version":"v"}]}',
    '{"models":[{"id":"x","name":{"x":1},"version":"v"}]}', '{"models":[{"id":"x","name":"X"}]}', '{"models":[{"id":"x","name":"X","version":null}]}',
    _reply("models", '"description":4'), _reply("models", '"description":null'), _reply("models", '"framework":null'),
    _reply("models", '"type":7'), _reply("models", '"created_at":"2024-01-05T10:00:00Z"'), _reply("models", '"created_at":"soon"'),
    _reply("models", '"other":[1,{"a":null}]'), _reply("experiments", '"status":null'), _reply("experiments", '"status":7'),
    _reply("runs", '"status":"done"'), _reply("runs", '"metrics":{"acc":"0.9"}'), _reply("runs", '"metrics":{"acc":"high"}'),
    _reply("runs", '"metrics":{"acc":true,"n":3}'), _reply("runs", '"metrics":{"acc":null}'), _reply("runs", '"metrics":{"acc":[1]}'),
    _reply("runs", '"metrics":[]'), _reply("runs", '"metrics":null'), _reply("runs", '"parameters":{"lr":0.001,"on":true,"name":"x","none":null}'),
    _reply("runs", '"parameters":"x"'), _reply("deployments", '"replicas":"two"'), _reply("deployments", '"replicas":2.5'),
    _reply("deployments", '"replicas":2.0'), _reply("deployments", '"replicas":" 4 "'), _reply("deployments", '"replicas":null'),
    _reply("deployments", '"replicas":true'), '{"deployments":[{"id":"x","name":"X"}]}', _reply("relationships", '"properties":"x"'),
    _reply("relationships", '"properties":{"w":1}'), '{"relationships":[{"source_id":"x","type":"SERVES"}]}',
    _reply("models") + " trailing", _reply("models") + _reply("models"), _reply("models") + "," + _reply("models"), _reply("models") + "]",
    "```json " + _reply("models") + " ``` and more", "  " + _reply("runs") + "  ", '{"models":[', "{'models':[]}",
]
_BRACES = str.maketrans({"{": "{{", "}": "}}"})
_ODD_ROWS = ", ".join(f"({k}, '{r.replace(chr(39), chr(39) * 2).translate(_BRACES)}')" for k, r in enumerate(ODD_REPLIES))

# Whole replies, and odd ones under ids of their own: one for every third document, each kind as often as the next.
RESPONSES = "WITH " + WHOLE_REPLIES + f""",
odd AS (SELECT k, reply FROM (VALUES {_ODD_ROWS}) AS v(k, reply))
SELECT doc_id, response FROM whole
UNION ALL
SELECT -1 - doc_id AS doc_id, reply AS response
FROM {{documents}} JOIN odd ON doc_id % 3 = 0 AND CAST(floor(doc_id / 3) AS BIGINT) % {len(ODD_REPLIES)} = k
"""

REQUESTS = """
SELECT event_id, ts, CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
  '/' || event_type AS endpoint,
  CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 95 THEN 500
       WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 90 THEN 404 ELSE 200 END AS status,
  value / 100 AS latency_s
FROM {events}
"""

COUNTERS = """
SELECT event_type AS endpoint, ts, event_id,
  count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS value
FROM {events}
"""

UP = """
SELECT event_type AS job, ts, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 END AS up FROM {events}
"""

AUDIT = """
SELECT event_id, ts, 'news_data_pipeline' AS pipeline, event_type AS stage,
  CASE WHEN value < 5 THEN 'failed' ELSE 'success' END AS status, props AS details
FROM {events}
"""

RUNS = """
SELECT 'run_' || CAST(o_orderkey AS STRING) AS run_id, CAST(0.75 + (o_orderkey % 25) / 100.0 AS DOUBLE) AS accuracy, o_orderdate AS finished_at
FROM {orders}
"""

ADAPTERS = {
    "items": ITEMS, "raw_landed": RAW_LANDED, "nodes": NODES, "edges": EDGES, "verdicts": VERDICTS, "judge_replies": JUDGE_REPLIES,
    "covers": COVERS, "diseases": DISEASES, "responses": RESPONSES, "requests": REQUESTS,
    "counters": COUNTERS, "up": UP, "audit": AUDIT, "runs": RUNS,
}


def _tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{([a-z]+)\}(?!\})", text)))


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run an adapter in Spark over the parquet tables of ``sf_dir``."""
    text = ADAPTERS[name]
    bound = {t: read_table(spark, sf_dir, t) for t in _tables_of(text)}
    return spark.sql(text, **bound)


def adapter_sql(name: str) -> str:
    """The same adapter as DuckDB SQL over the pre-registered views."""
    text = ADAPTERS[name]
    return text.format(**{t: t for t in _tables_of(text)})


# ---- typed views of the adapters used by the operators ----------------------------------

def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter(spark, sf_dir, "items")


def raw_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-raw as a 14-column raw article table (timestamps cast, absent columns NULL)."""
    df = adapter(spark, sf_dir, "raw_landed")
    return df.select(
        "article_id", "title", "source_name", F.lit(None).cast("string").alias("source_id"),
        F.lit(None).cast("string").alias("author"), "description", "content", "url",
        F.col("published_at_text").cast("timestamp").alias("published_at"),
        F.col("fetched_at_text").cast("timestamp").alias("fetched_at"),
        "query", "batch_id", "language", F.lit(None).cast("string").alias("raw_payload"))


RAW_LANDED_DUCK = """
SELECT article_id, title, source_name, CAST(NULL AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS author,
  description, content, url, CAST(published_at_text AS TIMESTAMP) AS published_at,
  CAST(fetched_at_text AS TIMESTAMP) AS fetched_at, query, batch_id, language, CAST(NULL AS VARCHAR) AS raw_payload
FROM ({inner}) r
"""


def raw_landed_sql() -> str:
    return RAW_LANDED_DUCK.format(inner=adapter_sql("raw_landed"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-requests with ``ts`` as an instant (TIMESTAMP); the tables store ``timestamp_ntz``."""
    return adapter(spark, sf_dir, "requests").withColumn("ts", F.col("ts").cast("timestamp"))


# Node updates in one extraction batch (repeated ids: the highest ``ord`` wins), some new ids.
NODE_BATCH = """
SELECT 'Model' AS label,
  CASE WHEN l_linenumber = 7 THEN 'model_x' ELSE 'model_' END || CAST(l_partkey AS STRING) AS id,
  'model ' || CAST(l_partkey AS STRING) AS name, 'v' || CAST(l_linenumber AS STRING) AS a1,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS a2,
  l_orderkey * 10 + l_linenumber AS ord
FROM {lineitem}
"""

# Relationship updates in one batch, applied in ``ord`` order; some endpoints never resolve.
EDGE_BATCH = """
SELECT 'model_' || CAST(l_partkey AS STRING) AS source_id,
  CASE WHEN l_orderkey % 89 = 0 THEN 'run_gone_' ELSE 'run_' END || CAST(l_orderkey AS STRING) AS target_id,
  'PRODUCED_BY' AS type, l_orderkey * 10 + l_linenumber AS ord,
  CAST(CAST(l_quantity AS BIGINT) AS STRING) AS qty,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag
FROM {lineitem}
"""

ADAPTERS.update({"node_batch": NODE_BATCH, "edge_batch": EDGE_BATCH})
ADAPTERS.update({"all_verdicts": ALL_VERDICTS, "open_nodes": OPEN_NODES, "checked_runs": CHECKED_RUNS, "paged_items": PAGED_ITEMS})
