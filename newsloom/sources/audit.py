"""Audit events, run logs and quarantine artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.functions.time import iso_format

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("pipeline", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("details", T.StringType())])


def audit_events(df: DataFrame, ts: str = "ts", pipeline: str = "pipeline", stage: str = "stage",
                 status: str = "status", details: str = "details") -> DataFrame:
    """``{timestamp, pipeline, stage, status, details}`` rows; details as JSON text."""
    d = F.col(details)
    d_json = d if isinstance(df.schema[details].dataType, T.StringType) else F.to_json(d)
    return df.select(iso_format(F.col(ts).cast("timestamp")).alias("timestamp"), F.col(pipeline).alias("pipeline"),
                     F.col(stage).alias("stage"), F.col(status).alias("status"), d_json.alias("details"))


def append_audit(events: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    events.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def audit_report(events: DataFrame) -> DataFrame:
    """Per (pipeline, stage): events, failures, successes, last event time and status."""
    ts = F.to_timestamp("timestamp")
    return events.groupBy("pipeline", "stage").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.max(ts).alias("last_ts"),
        F.max_by("status", F.struct(ts, F.col("status"))).alias("last_status"))


def run_report(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Runs of each pipeline and their failures. A run ends where no event follows for more than ``gap_seconds``.

    Per run: number, start, end, seconds, events, failures, its stages in the order they began, the first stage that failed, and
    ``failing_runs``: how many runs in a row, up to this one, failed. Events are summed per stage and time slot first (slots
    are no longer than the gap, so a slot lies in one run); what is then ordered has one row per slot, however many events
    there are. Events without a readable time take no part.
    """
    slot_seconds = min(60, gap_seconds)
    ts = F.unix_micros(F.try_to_timestamp("timestamp"))
    failed = F.col("status") == "failed"
    slots = (events.select("pipeline", "stage", ts.alias("ts"), failed.alias("failed")).where("ts is not null")
             .groupBy("pipeline", F.floor(F.col("ts") / (slot_seconds * 1_000_000)).alias("slot"), "stage")
             .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"),
                  F.count_if("failed").alias("bad"), F.min(F.when(F.col("failed"), F.col("ts"))).alias("first_bad")))
    per_slot = slots.groupBy("pipeline", "slot").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    order = Window.partitionBy("pipeline").orderBy("slot")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) > gap_seconds * 1_000_000, F.lit(True))
    numbered = per_slot.withColumn("starts", starts.cast("int")).select(
        "pipeline", "slot", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run_no"))
    stages = slots.join(numbered, ["pipeline", "slot"]).groupBy("pipeline", "run_no", "stage").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.min("first_bad").alias("first_bad"))
    runs = stages.groupBy("pipeline", "run_no").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("events"), F.sum("bad").alias("failures"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "stage"))), lambda s: s["stage"]), ">").alias("stages"),
        F.min(F.when(F.col("bad") > 0, F.struct("first_bad", "stage")))["stage"].alias("first_failed_stage"))
    so_far = Window.partitionBy("pipeline").orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    last_good = F.coalesce(F.max(F.when(F.col("failures") == 0, F.col("run_no"))).over(so_far), F.lit(0))
    return runs.select("pipeline", "run_no", F.timestamp_micros("first").alias("run_start"), F.timestamp_micros("last").alias("run_end"),
                       ((F.col("last") - F.col("first")) / 1_000_000).alias("seconds"), "events", "failures", "stages",
                       "first_failed_stage", (F.col("run_no") - last_good).alias("failing_runs"))


def run_log(runs: DataFrame, run_id: str, metrics: dict | None = None, ts: str | None = None,
            params: dict | None = None, texts: dict | None = None) -> DataFrame:
    """Long run log ``(run_id, kind, key, value, text, ts)``.

    ``metrics`` (log_metric) fill the numeric ``value``; ``params`` (log_param) and ``texts``
    (log_text) fill ``text``. Each mapping is key -> column name or Column expression.
    """
    parts = []
    for kind, mapping in (("metric", metrics or {}), ("param", params or {}), ("text", texts or {})):
        for key, expr in mapping.items():
            c = F.col(expr) if isinstance(expr, str) else expr
            parts.append(runs.select(
                F.col(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.lit(key).alias("key"),
                (c.cast("double") if kind == "metric" else F.lit(None).cast("double")).alias("value"),
                (c.cast("string") if kind != "metric" else F.lit(None).cast("string")).alias("text"),
                (F.col(ts) if ts else F.lit(None)).cast("timestamp").alias("ts")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pivot_run_log(log: DataFrame, keys: list[str], kind: str = "metric") -> DataFrame:
    """One row per run, one column per key of one kind (explicit keys: no extra distinct
    job); the latest logged value wins."""
    col = "value" if kind == "metric" else "text"
    return (log.filter(F.col("kind") == kind).groupBy("run_id").pivot("key", keys)
            .agg(F.max_by(col, F.struct("ts", col))))


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Failed validations as JSON for manual review (reason kept as text)."""
    rejected.write.mode("append").json(path)
