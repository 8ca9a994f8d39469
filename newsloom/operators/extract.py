"""Extraction prompts and response validation as column expressions.

The model call itself is outside service work; prompts and replies are columns. A reply is
parsed once, into a VARIANT; its lists are checked field by field by the types that occur
(``schema_of_variant``), cast to the declared extraction schema with higher-order functions, and
the replies are routed into valid / quarantine frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import contains_ci, strip_fence
from newsloom.operators.graph import (DEFAULT_CLUSTER, DEFAULT_EXPERIMENT_STATUS, DEFAULT_FRAMEWORK, DEFAULT_REPLICAS,
                                      DEFAULT_RUN_STATUS)

# ---- fixed values ------------------------------------------------------------------------------
# Denylisted model name (a known hallucination probe), matched case-insensitively.
DENYLIST = ("flux capacitor",)
RELATIONSHIP_TYPES = ("BELONGS_TO", "PRODUCED_BY", "SERVES")
# Prompt wording (ours).
EXTRACT_INSTRUCTIONS = (
    "Extract the machine-learning entities (models, experiments, runs, deployments) and the "
    "relationships between them (BELONGS_TO, PRODUCED_BY, SERVES) from the text below. "
    "Answer with one JSON object with the keys models, experiments, runs, deployments and "
    "relationships; use slug ids and only entities the text names.")
EXTRACT_TAIL = "Answer with the JSON object only."
JUDGE_INSTRUCTIONS = (
    "Check one extracted relationship against the source. Answer with JSON "
    "{\"status\": \"PASS\"|\"FAIL\"|\"WARN\", \"reasoning\": str, \"suggested_correction\": str}.")
# --------------------------------------------------------------------------------------------------

_S = T.StringType()
MODEL = T.StructType([T.StructField(n, _S) for n in ("id", "name", "version", "framework", "description")])
EXPERIMENT = T.StructType([T.StructField(n, _S) for n in ("id", "name", "status")])
RUN = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("status", _S),
                    T.StructField("metrics", T.MapType(_S, T.DoubleType())),
                    T.StructField("parameters", T.MapType(_S, _S))])
DEPLOYMENT = T.StructType([T.StructField("id", _S), T.StructField("name", _S), T.StructField("cluster", _S),
                           T.StructField("image", _S), T.StructField("replicas", T.LongType())])
RELATIONSHIP = T.StructType([T.StructField("source_id", _S), T.StructField("target_id", _S),
                             T.StructField("type", _S), T.StructField("properties", T.MapType(_S, _S))])
EXTRACTION = T.StructType([
    T.StructField("models", T.ArrayType(MODEL)), T.StructField("experiments", T.ArrayType(EXPERIMENT)),
    T.StructField("runs", T.ArrayType(RUN)), T.StructField("deployments", T.ArrayType(DEPLOYMENT)),
    T.StructField("relationships", T.ArrayType(RELATIONSHIP))])
VERDICT = T.StructType([T.StructField("status", _S), T.StructField("reasoning", _S),
                        T.StructField("suggested_correction", _S)])

# What the reply schema takes per field. Kinds: ``text`` (a JSON string), ``optional`` (a string or null), ``count`` (a whole
# number, also as 2.0, as text or as a boolean), ``numbers`` (an object of numbers, also as text or booleans), ``values`` (an
# object of anything), ``instant`` (a timestamp text or a number). The fields of REQUIRED must be present; no field but an
# optional one may be null.
FIELD_KINDS = {
    "models": {"id": "text", "name": "text", "version": "text", "framework": "text", "description": "optional",
               "type": "text", "created_at": "instant"},
    "experiments": {"id": "text", "name": "text", "status": "text", "type": "text", "created_at": "instant"},
    "runs": {"id": "text", "name": "text", "status": "text", "metrics": "numbers", "parameters": "values",
             "type": "text", "created_at": "instant"},
    "deployments": {"id": "text", "name": "text", "cluster": "text", "image": "text", "replicas": "count",
                    "type": "text", "created_at": "instant"},
    "relationships": {"source_id": "text", "target_id": "text", "type": "text", "properties": "values"}}
REQUIRED = {"models": ("id", "name", "version"), "experiments": ("id", "name"), "runs": ("id", "name"),
            "deployments": ("id", "name", "image"), "relationships": ("source_id", "target_id", "type")}
# Marks the end of the wrapped text, see _whole_json. A reply that holds it is junk.
END_MARK = "newsloom:end-of-reply"

# Properties of single labels: Model description, Run metrics and parameters, Deployment image and replicas.
NODE_PROPERTIES = {"description": "string", "metrics": "map<string,double>", "parameters": "map<string,string>",
                   "image": "string", "replicas": "bigint"}

ENTITY_LISTS = ("models", "experiments", "runs", "deployments")


def extraction_prompt(text) -> Column:
    """One prompt per document."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(EXTRACT_INSTRUCTIONS + "\n\nText:\n"), t, F.lit("\n\n" + EXTRACT_TAIL))


def judge_prompt(source_name, rel_type, target_name) -> Column:
    """One prompt per triple, naming both endpoints."""
    return F.concat(F.lit(JUDGE_INSTRUCTIONS + "\n\nTriple: "), F.coalesce(source_name, F.lit("?")),
                    F.lit(" -["), rel_type, F.lit("]-> "), F.coalesce(target_name, F.lit("?")))


def _whole_json(body: Column) -> Column:
    """The text as one VARIANT, NULL unless all of it is one JSON value. The parser ignores what follows the first value, so
    the text is parsed as the first of two elements: trailing text breaks the array or changes its length."""
    pair = F.try_parse_json(F.concat(F.lit("["), body, F.lit(f',"{END_MARK}"]')))
    return F.when(~F.contains(body, F.lit(END_MARK)), pair)


def _kind_of(v: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID (JSON null), OBJECT or ARRAY; NULL for an absent value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


NUMBER = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")
WHOLE_TEXT = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"


def _taken(v: Column, kind: str) -> Column:
    """Whether a present field has a type that the reply schema takes."""
    k = _kind_of(v)
    if kind == "text":
        return k == "STRING"
    if kind == "optional":
        return k.isin("STRING", "VOID")
    if kind == "count":
        number = _as(v, "double")
        return (k.isin("BIGINT", "BOOLEAN") | (k.isin("DECIMAL", "DOUBLE", "FLOAT") & (number == F.floor(number)))
                | ((k == "STRING") & _as(v, "string").rlike(WHOLE_TEXT) & _count(v).isNotNull()))
    if kind == "values":
        return k == "OBJECT"
    if kind == "numbers":
        each = F.map_values(_as(v, "map<string,variant>"))
        fits = lambda x: _kind_of(x).isin(*NUMBER) | ((_kind_of(x) == "STRING") & _as(x, "double").isNotNull())     # noqa: E731
        return (k == "OBJECT") & F.forall(each, fits)
    return k.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") | ((k == "STRING") & _as(v, "timestamp").isNotNull())


def _count(v: Column) -> Column:
    """A whole number, whichever way it is written."""
    text = F.regexp_extract(_as(v, "string"), r"^\s*([+-]?[0-9]+)", 1)
    return F.when(_kind_of(v) == "STRING", text.try_cast("bigint")).otherwise(_as(v, "bigint"))


def _value(v: Column, kind: str) -> Column:
    if kind == "count":
        return _count(v)
    return _as(v, {"numbers": "map<string,double>", "values": "map<string,string>"}.get(kind, "string"))


def _checked(root: Column, name: str) -> Column:
    """The list ``name`` as an array of (declared fields, _wrong, _missing); NULL where it isn't an array."""
    fields = EXTRACTION[name].dataType.elementType.fieldNames()

    def element(e: Column) -> Column:
        at = {f: F.try_variant_get(e, f"$.{f}", "variant") for f in FIELD_KINDS[name]}
        wrong, missing = ~F.coalesce(_kind_of(e) == "OBJECT", F.lit(False)), F.lit(False)
        for f, kind in FIELD_KINDS[name].items():
            wrong = wrong | (at[f].isNotNull() & ~F.coalesce(_taken(at[f], kind), F.lit(False)))
        for f in REQUIRED[name]:
            missing = missing | at[f].isNull()
        return F.struct(*[_value(at[f], FIELD_KINDS[name][f]).alias(f) for f in fields], wrong.alias("_wrong"), missing.alias("_missing"))

    return F.transform(F.try_variant_get(root, f"$.{name}", "array<variant>"), element)


def parse_responses(responses: DataFrame, text_col: str = "response") -> DataFrame:
    """Fence strip -> JSON -> typed checks -> status and reason.

    ``status``: ``junk`` (the whole text isn't one JSON value), ``invalid`` (no JSON object, a list or field of a type that
    the schema doesn't take, or a required field absent), ``rejected`` (denylisted model name), else ``valid``. Of a repeated
    key the last one counts (``spark.sql.variant.allowDuplicateKeys``, see session.py). Unknown keys are ignored.
    """
    lists = EXTRACTION.fieldNames()
    df = responses.withColumn("_body", strip_fence(F.col(text_col))).withColumn("_pair", _whole_json(F.col("_body")))
    two = F.coalesce((F.size(F.try_variant_get("_pair", "$", "array<variant>")) == 2)
                     & (F.try_variant_get("_pair", "$[1]", "string") == END_MARK), F.lit(False))
    df = df.withColumn("_v", F.when(two, F.try_variant_get("_pair", "$[0]", "variant")))
    df = df.select(*responses.columns, F.col("_v").isNotNull().alias("_ok"), F.coalesce(_kind_of(F.col("_v")) == "OBJECT", F.lit(False)).alias("_object"),
                   *[_checked(F.col("_v"), k).alias(f"_{k}") for k in lists],
                   *[F.try_variant_get("_v", f"$.{k}", "variant").isNotNull().alias(f"_has_{k}") for k in lists])
    wrong, missing = F.lit(False), F.lit(False)
    for k in lists:
        wrong = wrong | (F.col(f"_has_{k}") & F.col(f"_{k}").isNull()) | F.exists(F.coalesce(F.col(f"_{k}"), F.array()), lambda e: e["_wrong"])
        missing = missing | F.exists(F.coalesce(F.col(f"_{k}"), F.array()), lambda e: e["_missing"])
    deny = F.lit(False)
    for term in DENYLIST:
        deny = deny | F.exists(F.coalesce(F.col("_models"), F.array()), lambda m: F.coalesce(contains_ci(m["name"], term), F.lit(False)))
    reason = (F.when(~F.col("_ok"), "response is not JSON")
              .when(~F.col("_object"), "response is not a JSON object")
              .when(wrong, "a field has the wrong type")
              .when(missing, "a required field is missing")
              .when(deny, "denylisted model name"))
    df = df.select(*responses.columns, "_ok", reason.alias("reason"), *[f"_{k}" for k in lists])
    status = (F.when(~F.col("_ok"), "junk").when(F.col("reason").isNull(), "valid")
              .when(F.col("reason") == "denylisted model name", "rejected").otherwise("invalid"))
    # NULL arrays count 0 (explicitly: with ANSI off, size(NULL) is -1 rather than NULL)
    sizes = [F.when(F.col(f"_{k}").isNull(), F.lit(0)).otherwise(F.size(f"_{k}")).cast("bigint").alias(f"n_{k}") for k in lists]
    declared = lambda k: F.transform(f"_{k}", lambda e: F.struct(*[e[f].alias(f) for f in EXTRACTION[k].dataType.elementType.fieldNames()]))
    return df.select(*responses.columns, status.alias("status"), "reason", F.length(text_col).cast("bigint").alias("response_chars"),
                     *sizes, *[declared(k).alias(k) for k in lists])


def route(parsed: DataFrame, materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid rows go on to ingestion, the rest to the review quarantine.

    Both branches are filters over one materialised parse (reliable checkpoint in the shared
    checkpoint folder): otherwise each branch re-parses, and the pushed-down status predicate
    would re-evaluate ``from_json`` once per field it inspects.
    """
    if materialize:
        parsed = parsed.checkpoint(eager=True)
    return parsed.filter(F.col("status") == "valid"), parsed.filter(F.col("status") != "valid")


def explode_entities(parsed: DataFrame, kind: str, id_col: str = "doc_id") -> DataFrame:
    """T5: one row per extracted entity/relationship of one kind (``inline``)."""
    return parsed.select(id_col, F.inline_outer(F.coalesce(F.col(kind), F.array().cast(parsed.schema[kind].dataType)))) \
        .filter(F.col(parsed.schema[kind].dataType.elementType.fieldNames()[0]).isNotNull())


def extraction_counts(parsed: DataFrame) -> DataFrame:
    """Entities per extraction = models + runs + deployments (experiments not counted)."""
    return parsed.groupBy("status").agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum(F.col("n_models") + F.col("n_runs") + F.col("n_deployments")).alias("entity_count"),
        F.sum("n_relationships").alias("relationship_count"),
        F.sum("response_chars").alias("response_chars"))


def schema_compliance(parsed: DataFrame) -> DataFrame:
    """Share of replies that parse and carry every required field."""
    ok = F.col("status").isin("valid", "rejected")
    return parsed.agg(F.count(F.lit(1)).alias("responses"), F.count_if(ok).alias("compliant"),
                      F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("compliance_rate"))


def parse_verdicts(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """Judge replies -> status in PASS/FAIL/WARN (else NULL), reasoning, correction."""
    # the parsed reply is a column of its own, so that it is parsed once and not once per field
    v, names = F.col("_verdict"), [F.col(f"`{c}`") for c in replies.columns]
    st = F.upper(F.trim(v["status"]))
    parsed = replies.withColumn("_verdict", F.from_json(strip_fence(F.col(text_col)), VERDICT))
    return parsed.select(*names, F.when(st.isin("PASS", "FAIL", "WARN"), st).alias("status"),
                         v["reasoning"].alias("reasoning"), v["suggested_correction"].alias("suggested_correction"))


def extraction_batches(valid: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """T5: valid extractions -> (node batch, edge batch) in the generic graph shape.

    Nodes: ``(label, id, name, a1, a2, ord)`` with the per-label property slots of
    ``graph.project_nodes`` (Model: version/framework, Experiment and Run: status, Deployment:
    cluster) and the columns of ``NODE_PROPERTIES``; absent values take the schema defaults. Edges: ``(source_id, target_id, type, properties, ord)``.
    ``ord`` is the document id, so a later document's values win on repeated ids.
    """
    empty = F.create_map().cast("map<string,string>")

    def nodes_of(kind: str, label: str, a1: Column, a2: Column | None = None, **props: Column) -> DataFrame:
        e = explode_entities(valid, kind, id_col)
        return e.select(F.lit(label).alias("label"), "id", "name", a1.cast("string").alias("a1"),
                        (F.lit(None) if a2 is None else a2).cast("string").alias("a2"),
                        *[props.get(p, F.lit(None)).cast(t).alias(p) for p, t in NODE_PROPERTIES.items()],
                        F.col(id_col).cast("bigint").alias("ord"))
    or_default = lambda c, d: F.coalesce(F.col(c), F.lit(d))                        # noqa: E731
    nodes = (nodes_of("models", "Model", F.col("version"), or_default("framework", DEFAULT_FRAMEWORK),
                      description=F.col("description"))
             .unionByName(nodes_of("experiments", "Experiment", or_default("status", DEFAULT_EXPERIMENT_STATUS)))
             .unionByName(nodes_of("runs", "Run", or_default("status", DEFAULT_RUN_STATUS),
                                   metrics=F.coalesce("metrics", empty.cast("map<string,double>")),
                                   parameters=F.coalesce("parameters", empty)))
             .unionByName(nodes_of("deployments", "Deployment", or_default("cluster", DEFAULT_CLUSTER),
                                   image=F.col("image"), replicas=or_default("replicas", DEFAULT_REPLICAS))))
    rel = explode_entities(valid, "relationships", id_col)
    edges = rel.select("source_id", "target_id", "type",
                       F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
                       F.col(id_col).cast("bigint").alias("ord"))
    return nodes, edges
