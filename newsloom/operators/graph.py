"""Property graph as two DataFrames: ``nodes(id, label, name, a1, a2, ...)`` and
``edges(source_id, target_id, type, properties, ingested_at)``.

Pattern matches are equi-joins; node and edge upserts are joins/aggregates on the keys.
Nothing here broadcasts a data-dependent side explicitly: with AQE on, Spark turns a join
into a broadcast join only when the runtime size of a side is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.maps import merge_properties
from newsloom.functions.text import canonical_status, slugify
from newsloom.functions.time import as_timestamp

# ---- fixed values: per-label property defaults ----------------------------------------------
DEFAULT_FRAMEWORK = "pytorch"
DEFAULT_EXPERIMENT_STATUS = "active"
DEFAULT_RUN_STATUS = "completed"
DEFAULT_CLUSTER = "local-k8s"
DEFAULT_REPLICAS = 1
LABELS = ("Model", "Experiment", "Run", "Deployment")
# -----------------------------------------------------------------------------------------------

EDGE_KEY = ["source_id", "type", "target_id"]
EDGE_HASH = "_edge_hash"


def project_nodes(nodes: DataFrame) -> DataFrame:
    """Per-label property columns with the schema defaults.

    Model(name, version, framework, description), Experiment(name, status),
    Run(name, status, metrics, parameters), Deployment(name, cluster, image, replicas).
    The generic ``a1``/``a2`` slots hold version/framework, status, segment or cluster. The other properties come from
    columns of their names (as the upsert keeps them) or from ``props``, the open property set as a VARIANT.
    """
    label = F.col("label")

    def prop(name: str, kind: str, of: str) -> Column:
        if name in nodes.columns:
            value = F.col(name)
        else:
            value = F.try_variant_get("props", f"$.{name}", kind) if "props" in nodes.columns else F.lit(None)
        return F.when(label == of, value.cast(kind))
    return nodes.select(
        "id", "label", "name", slugify("name").alias("slug"),
        F.when(label == "Model", F.col("a1")).alias("version"),
        F.when(label == "Model", F.coalesce(F.col("a2"), F.lit(DEFAULT_FRAMEWORK))).alias("framework"),
        F.when(label == "Experiment", F.coalesce(canonical_status("a1"), F.lit(DEFAULT_EXPERIMENT_STATUS)))
         .when(label == "Run", F.coalesce(canonical_status("a1"), F.lit(DEFAULT_RUN_STATUS))).alias("status"),
        F.when(label == "Deployment", F.coalesce(F.col("a1"), F.lit(DEFAULT_CLUSTER))).alias("cluster"),
        prop("description", "string", "Model").alias("description"),
        F.when(label == "Run", F.coalesce(prop("metrics", "map<string,double>", "Run"), F.create_map().cast("map<string,double>")))
         .alias("metrics"),
        F.when(label == "Run", F.coalesce(prop("parameters", "map<string,string>", "Run"), F.create_map().cast("map<string,string>")))
         .alias("parameters"),
        prop("image", "string", "Deployment").alias("image"),
        F.when(label == "Deployment", F.coalesce(prop("replicas", "bigint", "Deployment"), F.lit(DEFAULT_REPLICAS).cast("bigint")))
         .alias("replicas"))


def last_per_id(batch: DataFrame, key=("label", "id"), order="ord") -> DataFrame:
    """Batch dedup: a repeated id in one batch -> the last one wins (partial aggregation).

    ``order`` is a column name or a list of them (later names break ties of earlier ones).
    """
    order = [order] if isinstance(order, str) else list(order)
    cols = [c for c in batch.columns]
    return (batch.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
            .select("_r.*"))


def upsert_nodes(target: DataFrame, batch: DataFrame, props: list[str], as_of=None,
                 key=("label", "id"), order="ord") -> DataFrame:
    """``MERGE (n:Label {id}) SET n.p = batch.p, ...``.

    Listed properties of matched nodes are overwritten (a NULL clears them), unmatched batch
    rows are inserted, untouched nodes stay as they are. Other columns of the target are kept (NULL for
    inserted rows). ``created_at`` is kept from the first insert and ``last_updated`` is set for every touched node. One full outer join on the key; both sides
    are unique by key (the target by definition, the batch after :func:`last_per_id`), so no key
    can be hot, whatever the batch's duplication.
    """
    b = last_per_id(batch, key, order).select(*key, *[F.col(p).alias(f"_n_{p}") for p in props],
                                              F.lit(True).alias("_touched"))
    t = target
    if "created_at" not in t.columns:
        t = t.withColumn("created_at", F.lit(None).cast("timestamp"))
    if "last_updated" not in t.columns:
        t = t.withColumn("last_updated", F.lit(None).cast("timestamp"))
    for p in props:
        if p not in t.columns:
            t = t.withColumn(p, F.lit(None).cast(batch.schema[p].dataType))
    j = t.join(b, list(key), "full_outer")
    now = as_timestamp(as_of)
    touched = F.coalesce(F.col("_touched"), F.lit(False))
    out = [F.col(k) for k in key]
    out += [F.when(touched, F.col(f"_n_{p}")).otherwise(F.col(p)).alias(p) for p in props]
    out += [F.col(c) for c in target.columns if c not in {*key, *props, "created_at", "last_updated"}]
    out += [F.when(touched, F.coalesce(F.col("created_at"), now)).otherwise(F.col("created_at")).alias("created_at"),
            F.when(touched, now).otherwise(F.col("last_updated")).alias("last_updated")]
    return j.select(*out)


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``MATCH (s {id}), (t {id})`` without labels: two inner equi-joins.

    Edges with a missing endpoint vanish; an id present under k labels matches k times.
    """
    s = nodes.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"),
                     F.col("name").alias("source_name"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("label").alias("target_label"),
                     F.col("name").alias("target_name"))
    return edges.join(s, "source_id").join(t, "target_id")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges J3 drops, with the missing side as the reason."""
    ids = nodes.select("id").distinct()
    s = ids.select(F.col("id").alias("source_id"), F.lit(True).alias("_s"))
    t = ids.select(F.col("id").alias("target_id"), F.lit(True).alias("_t"))
    j = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    reason = (F.when(F.col("_s").isNull() & F.col("_t").isNull(), "missing_both")
              .when(F.col("_s").isNull(), "missing_source").otherwise("missing_target"))
    return (j.filter(F.col("_s").isNull() | F.col("_t").isNull())
            .select(*edges.columns, reason.alias("reason")))


def fold_properties(batch: DataFrame, order="ord") -> DataFrame:
    """Fold a batch of ``SET r += props`` updates into one update map per edge.

    Per (edge, property key) the value of the last update wins (equal orders: the larger value),
    NULL included, so a later NULL still removes the key when merged. One aggregate over the
    exploded entries with map-side combine, then one small collect per edge (bounded by the
    number of distinct property keys, not by the number of updates). A hash of the edge leads the keys: edges share long
    prefixes of their ids, and a sort by the hash seldom compares texts.
    """
    order = [order] if isinstance(order, str) else list(order)
    e = batch.select(F.xxhash64(*EDGE_KEY).alias(EDGE_HASH), *EDGE_KEY, F.struct(*[F.col(o) for o in order]).alias("_ord"),
                     F.explode_outer(F.map_entries(F.col("properties"))).alias("_e"))
    per_key = (e.groupBy(EDGE_HASH, *EDGE_KEY, F.col("_e.key").alias("k"))
               .agg(F.max_by(F.struct(F.col("_e.value").alias("v")), F.struct("_ord", F.col("_e.value"))).alias("_w")))
    return per_key.groupBy(EDGE_HASH, *EDGE_KEY).agg(
        F.map_from_entries(F.filter(F.collect_list(F.struct(F.col("k"), F.col("_w.v").alias("v"))),
                                    lambda x: x["k"].isNotNull())).alias("_update"))


def upsert_edges(target: DataFrame, batch: DataFrame, nodes: DataFrame, as_of=None, order="ord") -> DataFrame:
    """``MATCH (s), (t) MERGE (s)-[r:TYPE]->(t) SET r += props, r.ingested_at = now``.

    Batch edges whose endpoints do not resolve (J3) are not created. The batch is folded to one
    update map per edge (:func:`fold_properties`), then a single full outer join on the edge key
    applies it with the map merge F13; untouched edges pass through unchanged. Both join sides
    are unique by edge key (the batch after folding), so the outer join cannot be skewed by a key.
    """
    ids = nodes.select("id").distinct()
    resolved = (batch.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
                .join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"))
    updates = fold_properties(resolved, order).withColumn("_touched", F.lit(True))
    j = target.withColumn(EDGE_HASH, F.xxhash64(*EDGE_KEY)).join(updates, [EDGE_HASH, *EDGE_KEY], "full_outer")
    touched = F.coalesce(F.col("_touched"), F.lit(False))
    return j.select(*EDGE_KEY,
                    F.when(touched, merge_properties(F.col("properties"), F.col("_update")))
                     .otherwise(F.col("properties")).alias("properties"),
                    F.when(touched, as_timestamp(as_of)).otherwise(F.col("ingested_at")).alias("ingested_at"))


def model_details(nodes: DataFrame, edges: DataFrame, name: str | None = None) -> DataFrame:
    """``MATCH (m:Model {name}) OPTIONAL MATCH (m)-[:PRODUCED_BY]->(r:Run) RETURN m, r``.

    Edges are joined to runs first (inner), so a dangling edge does not add a row. The optional
    match is an inner join (AQE can split a hub model's many runs across tasks) plus the models
    without runs from an anti join against the *distinct* producing model ids; a plain left join
    would leave a hub model's rows on the side AQE cannot split.
    """
    models = nodes.filter(F.col("label") == "Model")
    if name is not None:
        models = models.filter(F.col("name") == name)
    models = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"),
                           F.col("a1").alias("model_version"))
    runs = nodes.filter(F.col("label") == "Run").select(
        F.col("id").alias("run_id"), F.col("name").alias("run_name"), F.col("a1").alias("run_status"))
    produced = (edges.filter(F.col("type") == "PRODUCED_BY")
                .select(F.col("source_id").alias("model_id"), F.col("target_id").alias("run_id"))
                .join(runs, "run_id"))
    matched = models.join(produced, "model_id")
    lonely = models.join(produced.select("model_id").distinct(), "model_id", "left_anti").select(
        *models.columns, *[F.lit(None).cast("string").alias(c) for c in ("run_id", "run_name", "run_status")])
    return matched.select(*lonely.columns).unionByName(lonely)


def deployment_status(nodes: DataFrame, edges: DataFrame, deployment_id: str | None = None) -> DataFrame:
    """``MATCH (d:Deployment {id})-[:SERVES]->(m:Model) RETURN d, m``."""
    deps = nodes.filter(F.col("label") == "Deployment")
    if deployment_id is not None:
        deps = deps.filter(F.col("id") == deployment_id)
    models = nodes.filter(F.col("label") == "Model").select(
        F.col("id").alias("model_id"), F.col("name").alias("model_name"))
    serves = edges.filter(F.col("type") == "SERVES").select(
        F.col("source_id").alias("deployment_id"), F.col("target_id").alias("model_id"))
    return (deps.select(F.col("id").alias("deployment_id"), F.col("name").alias("deployment_name"),
                        F.col("a1").alias("cluster"))
            .join(serves, "deployment_id").join(models, "model_id"))


def _typed_edges(resolved: DataFrame, etype: str, src_label: str, dst_label: str, src: str, dst: str) -> DataFrame:
    """Edges of one type whose endpoints carry the given labels, from the resolved edges.

    Every typed edge set is a filter over the same resolved frame, so the endpoint lookups are
    done once (their shuffles are reused) instead of two semi joins per edge type.
    """
    return (resolved.filter((F.col("type") == etype) & (F.col("source_label") == src_label)
                            & (F.col("target_label") == dst_label))
            .select(F.col("source_id").alias(src), F.col("target_id").alias(dst)))


def lineage_paths(nodes: DataFrame, edges: DataFrame, deployment_id: str) -> DataFrame:
    """J7 for one deployment: Deployment SERVES Model PRODUCED_BY Run BELONGS_TO Experiment."""
    r = resolve_edges(edges, nodes)
    serves = _typed_edges(r, "SERVES", "Deployment", "Model", "deployment_id", "model_id") \
        .filter(F.col("deployment_id") == deployment_id)
    produced = _typed_edges(r, "PRODUCED_BY", "Model", "Run", "model_id", "run_id")
    belongs = _typed_edges(r, "BELONGS_TO", "Run", "Experiment", "run_id", "experiment_id")
    return serves.join(produced, "model_id").join(belongs, "run_id")


def lineage_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """J7 over the whole graph, per deployment: served models, model->run paths and
    model->run->experiment paths along Deployment SERVES Model PRODUCED_BY Run BELONGS_TO Experiment.

    Counts are pushed down the chain (experiments per run, then runs and paths per model), so
    every join is linear in the edge count; no deployment x run or deployment x experiment pairs
    are formed, however many edges a hub model has.
    """
    r = resolve_edges(edges, nodes)
    serves = _typed_edges(r, "SERVES", "Deployment", "Model", "deployment_id", "model_id")
    produced = _typed_edges(r, "PRODUCED_BY", "Model", "Run", "model_id", "run_id")
    belongs = _typed_edges(r, "BELONGS_TO", "Run", "Experiment", "run_id", "experiment_id")
    exp_per_run = belongs.groupBy("run_id").agg(F.count(F.lit(1)).alias("_e"))
    per_model = (produced.join(exp_per_run, "run_id", "left")
                 .groupBy("model_id").agg(F.count(F.lit(1)).alias("_r"), F.sum(F.coalesce("_e", F.lit(0))).alias("_p")))
    return (serves.join(per_model, "model_id", "left")
            .groupBy("deployment_id")
            .agg(F.count(F.lit(1)).alias("model_count"),
                 F.sum(F.coalesce("_r", F.lit(0))).cast("bigint").alias("run_paths"),
                 F.sum(F.coalesce("_p", F.lit(0))).cast("bigint").alias("experiment_paths")))


def graph_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Relationship types between labels, derived from the resolved edges."""
    return (resolve_edges(edges, nodes)
            .groupBy("source_label", "type", "target_label").agg(F.count(F.lit(1)).alias("edge_count")))


def label_properties(nodes: DataFrame) -> DataFrame:
    """Labels with the number of nodes that set each of the fixed properties."""
    return nodes.groupBy("label").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count("name").alias("with_name"), F.count("a1").alias("with_a1"), F.count("a2").alias("with_a2"))


def property_report(nodes: DataFrame, fixed=("name", "a1", "a2")) -> DataFrame:
    """Per label every property that occurs, fixed column or key of the open set ``props`` (a VARIANT), with the number
    of nodes that set it and the merged type of its values. JSON null counts as not set.

    One pass: a row per node and property, aggregated map-side; the result has a row per label and property.
    """
    column = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").cast("variant").alias("value")) for c in fixed]
    open_ = F.coalesce(F.map_entries(F.try_variant_get("props", "$", "map<string,variant>")), F.array())
    every = F.concat(F.array(*column), F.transform(open_, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    rows = nodes.select("label", F.inline(every)).where(F.col("value").isNotNull()).where(~F.is_variant_null("value"))
    return rows.groupBy("label", F.col("key").alias("property")).agg(
        F.count(F.lit(1)).alias("nodes"), F.schema_of_variant_agg("value").alias("type"))


def label_scan(nodes: DataFrame, label: str, limit: int = 25, columns=("id", "name", "a1")) -> DataFrame:
    """``MATCH (m:Label) RETURN ... LIMIT n`` with an id order for determinism."""
    return nodes.filter(F.col("label") == label).select(*columns).orderBy("id").limit(limit)


def name_lookup(nodes: DataFrame, name: str) -> DataFrame:
    """Equality lookup on ``name`` (pushed into the scan; sorted files skip row groups)."""
    return nodes.filter(F.col("name") == F.lit(name))


# ---- evaluation metrics over judge verdicts and ground truth --------------------------------------

def judge_metrics(verdicts: DataFrame) -> DataFrame:
    """PASS/WARN/FAIL counts and the pass rate per relationship type."""
    status = F.upper(F.trim(F.col("status")))
    return verdicts.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(status == "PASS").alias("n_pass"),
        F.count_if(status == "WARN").alias("n_warn"),
        F.count_if(status == "FAIL").alias("n_fail"),
        F.count_if(~status.isin("PASS", "WARN", "FAIL")).alias("n_unknown"),
        F.round(F.avg(F.when(status == "PASS", 1.0).otherwise(0.0)), 6).alias("pass_rate"))


def hallucination_rate(relationships: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Share of relationships not in ground truth (J9 anti join) or rejected (FAIL)."""
    # a relationship counts once, however many verdicts it has: supported if any says so, rejected if any rejects it.
    # Both sides meet in one aggregate with map-side combine, where a sort-merge join would sort both by three texts; a
    # verdict with a NULL in its key meets no relationship.
    key = [F.col(c) for c in EDGE_KEY]
    known = F.lit(True)
    for c in key:
        known = known & c.isNotNull()
    sides = relationships.select(*key, F.lit(1).cast("bigint").alias("_n"), F.lit(False).alias("_truth"), F.lit(False).alias("_failed")).unionAll(
        verdicts.where(known).select(*key, F.lit(0).cast("bigint"), F.coalesce(F.col("in_truth"), F.lit(False)),
                                     F.coalesce(F.upper(F.trim("status")) == "FAIL", F.lit(False))))
    j = sides.groupBy(*EDGE_KEY).agg(F.sum("_n").alias("_n"), F.max("_truth").alias("_truth"), F.max("_failed").alias("_failed"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n")).otherwise(0)), F.lit(0)).cast("bigint")           # noqa: E731
    n, bad = of(F.lit(True)), of(~F.col("_truth") | F.col("_failed"))
    return j.agg(
        n.alias("n_relationships"), of(~F.col("_truth")).alias("n_unsupported"), of(F.col("_failed")).alias("n_rejected"),
        F.round(F.try_divide(bad.cast("double"), n), 6).alias("hallucination_rate"))


def unsupported_edges(relationships: DataFrame, truth: DataFrame) -> DataFrame:
    """Relationships without a ground-truth counterpart."""
    return relationships.join(truth.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def coverage(all_items: DataFrame, covers: DataFrame, id_col: str = "id") -> DataFrame:
    """Covered / all (distinct), NULL when there is nothing to cover."""
    covered = all_items.select(id_col).join(covers.select(F.col("target_id").alias(id_col)), id_col, "left_semi")
    tagged = (all_items.select(id_col, F.lit(False).alias("_c"))
              .unionByName(covered.select(id_col, F.lit(True).alias("_c"))))
    agg = tagged.groupBy(id_col).agg(F.max("_c").alias("_c"))
    return agg.agg(F.count(F.lit(1)).alias("n_total"), F.count_if("_c").alias("n_covered")).select(
        "n_total", "n_covered",
        F.when(F.col("n_total") == 0, F.lit(None).cast("double"))
         .otherwise(F.round(F.col("n_covered") / F.col("n_total"), 6)).alias("coverage"))
