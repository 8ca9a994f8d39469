"""Request telemetry over a request log ``(ts, method, endpoint, status, latency_s)``.

The dashboard queries (request rate, 5xx rate, latency quantile from histogram buckets,
last non-null ``up``) become grouped aggregates; all of them aggregate map-side first, so
a hot endpoint never concentrates raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import label_regex_match
from newsloom.functions.time import as_timestamp

# ---- fixed values ------------------------------------------------------------------------------
# Default latency histogram buckets of the metrics client (seconds); +Inf is implicit.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
INF_LABEL = "+Inf"
# Route templates: a concrete path matching the pattern is counted under the template.
ROUTE_TEMPLATES = (
    (r"^/model/[^/]+/details$", "/model/{name}/details"),
    (r"^/deployment/[^/]+/status$", "/deployment/{deployment_id}/status"),
)
FAILURE_STATUS = 500
# -------------------------------------------------------------------------------------------------


def route_template(path) -> Column:
    """The route template of a concrete path (low-cardinality endpoint label)."""
    p = F.col(path) if isinstance(path, str) else path
    out = p
    for pattern, template in reversed(ROUTE_TEMPLATES):
        out = F.when(p.rlike(pattern), F.lit(template)).otherwise(out)
    return out


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests by (method, endpoint template, status); failures count as 500."""
    status = F.coalesce(F.col("status").cast("int"), F.lit(FAILURE_STATUS))
    return (requests.select("method", route_template("endpoint").alias("endpoint"), status.alias("status"))
            .groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("requests")))


def prediction_errors(requests: DataFrame) -> DataFrame:
    """Processed requests and failures (status >= 500) per endpoint."""
    return requests.groupBy(route_template("endpoint").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.coalesce(F.col("status").cast("int"), F.lit(FAILURE_STATUS)) >= 500).alias("errors"))


def _le_text(b: float) -> str:
    return repr(float(b))


def latency_buckets(requests: DataFrame, group_cols=("endpoint",), buckets=DEFAULT_BUCKETS,
                    latency: str = "latency_s") -> DataFrame:
    """Cumulative histogram buckets, sum and count per group, in long form.

    One aggregate computes every cumulative bucket as a conditional count (partial aggregation
    per task), then ``stack`` turns the wide row into one row per ``le``.
    """
    lat = F.col(latency)
    aggs = [F.count_if(lat <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(buckets)]
    aggs += [F.count(lat).alias("_b_inf"), F.sum(lat).alias("latency_sum")]
    wide = requests.groupBy(*group_cols).agg(*aggs)
    pairs = ", ".join([f"'{_le_text(b)}', {float(b)}D, _b{i}" for i, b in enumerate(buckets)]
                      + [f"'{INF_LABEL}', CAST('Infinity' AS DOUBLE), _b_inf"])
    n = len(buckets) + 1
    return wide.select(*group_cols, "latency_sum", F.col("_b_inf").alias("latency_count"),
                       F.expr(f"stack({n}, {pairs}) AS (le, le_value, bucket_count)"))


def histogram_quantile(q: float, group_cols=("endpoint",), buckets=DEFAULT_BUCKETS):
    """W5 as aggregate expressions: returns ``(aggs, finish)``.

    ``aggs`` are the cumulative bucket counts and the total; ``finish(df)`` turns them into the
    quantile with the usual rule: rank = q * total; the first bucket whose cumulative count
    reaches the rank; linear interpolation inside ``(previous le, le]`` with 0 as the first lower
    bound; a rank in the +Inf bucket returns the largest finite bound; no observations -> NULL.
    """
    def aggs(latency: Column):
        return ([F.count_if(latency <= F.lit(b)).alias(f"_c{i}") for i, b in enumerate(buckets)]
                + [F.count(latency).alias("_total")])

    def finish(df: DataFrame) -> DataFrame:
        n = len(buckets)
        les = F.array(*[F.lit(float(b)) for b in buckets])
        cums = F.array(*[F.col(f"_c{i}").cast("double") for i in range(n)])
        total = F.col("_total").cast("double")
        rank = F.lit(float(q)) * total
        idx = F.try_element_at(F.filter(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(cums, i) >= rank), F.lit(1))
        prev_le = F.when(idx > 1, F.element_at(les, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0.0))
        prev_cum = F.when(idx > 1, F.element_at(cums, F.greatest(idx - 1, F.lit(1)))).otherwise(F.lit(0.0))
        le = F.element_at(les, F.coalesce(idx, F.lit(1)))
        cnt = F.element_at(cums, F.coalesce(idx, F.lit(1))) - prev_cum
        interp = F.when(cnt > 0, prev_le + (le - prev_le) * ((rank - prev_cum) / cnt)).otherwise(prev_le)
        value = (F.when(total <= 0, F.lit(None).cast("double"))
                 .when(idx.isNull(), F.lit(float(buckets[-1])))
                 .otherwise(interp))
        keep = [c for c in df.columns if not (c.startswith("_c") or c == "_total")]
        return df.select(*keep, value.alias("quantile"))

    return aggs, finish


def latency_quantile(requests: DataFrame, q: float = 0.95, group_cols=("endpoint",), buckets=DEFAULT_BUCKETS,
                     latency: str = "latency_s") -> DataFrame:
    """``histogram_quantile(q, sum(rate(bucket)) by (le, group))`` over the whole input."""
    aggs, finish = histogram_quantile(q, group_cols, buckets)
    return finish(requests.groupBy(*group_cols).agg(*aggs(F.col(latency))))


def windowed_latency_quantile(requests: DataFrame, q: float = 0.95, length: str = "5 minutes",
                              step: str = "1 minute", buckets=DEFAULT_BUCKETS, latency: str = "latency_s") -> DataFrame:
    """W5 per evaluation window (sliding ``length`` every ``step``), summed over endpoints."""
    aggs, finish = histogram_quantile(q, ("window",), buckets)
    w = requests.groupBy(F.window("ts", length, step).alias("window")).agg(*aggs(F.col(latency)))
    out = finish(w)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "quantile")


def window_seconds(length: str) -> float:
    """Seconds in a window length such as ``\"5 minutes\"``."""
    num, unit = length.split()
    scale = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
             "day": 86400, "days": 86400}[unit]
    return float(num) * scale


def request_rate(requests: DataFrame, length: str = "5 minutes", step: str = "1 minute",
                 group_cols=("endpoint",)) -> DataFrame:
    """``sum(rate(requests[length])) by (group)`` at every ``step``: count / window seconds.

    Half-open windows ``[start, start + length)``, no boundary extrapolation.
    """
    secs = window_seconds(length)
    w = requests.groupBy(F.window("ts", length, step).alias("window"), *group_cols).agg(
        F.count(F.lit(1)).alias("requests"))
    return w.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    *group_cols, "requests", F.round(F.col("requests") / F.lit(secs), 9).alias("rate"))


def error_rate(requests: DataFrame, length: str = "5 minutes", step: str = "1 minute",
               status_regex: str = "5..") -> DataFrame:
    """``sum(rate(requests{status=~"5.."}[length]))`` (anchored label regex)."""
    errors = requests.filter(label_regex_match(F.col("status").cast("string"), status_regex))
    return request_rate(errors, length, step, group_cols=())


def counter_increase(samples: DataFrame, series=("endpoint",), ts: str = "ts", value: str = "value",
                     tiebreak: str | None = "event_id", chunk: str = "minute") -> DataFrame:
    """Per-sample increase of a cumulative counter that may reset.

    ``inc = value - previous`` when the counter grew, ``value`` when it dropped (a reset), and 0
    for the first sample of a series. The previous sample comes from a ``lag`` over series
    *and* time chunk, so one hot series is split into many window partitions; each chunk's first
    sample then takes its predecessor from the previous chunk's last sample, found with a small
    window over per-chunk aggregates.
    """
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    df = samples.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    w = Window.partitionBy(*series, "_chunk").orderBy(*order)
    df = df.withColumn("_prev", F.lag(value).over(w))
    ord_struct = F.struct(*order)
    last = (df.groupBy(*series, "_chunk").agg(F.max_by(F.col(value), ord_struct).alias("_last")))
    cw = Window.partitionBy(*series).orderBy("_chunk")
    carry = last.select(*series, "_chunk", F.lag("_last").over(cw).alias("_carry"))
    df = df.join(carry, [*series, "_chunk"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    v = F.col(value)
    inc = F.when(prev.isNull(), F.lit(0)).when(v < prev, v).otherwise(v - prev)
    return df.select(*samples.columns, inc.alias("increase"))


def counter_rate(samples: DataFrame, length: str = "1 hour", series=("endpoint",), ts: str = "ts",
                 value: str = "value", tiebreak: str | None = "event_id") -> DataFrame:
    """Rate from scraped counter samples: summed increases per tumbling window / seconds."""
    inc = counter_increase(samples, series, ts, value, tiebreak)
    secs = window_seconds(length)
    w = inc.groupBy(F.window(ts, length).alias("window"), *series).agg(F.sum("increase").alias("increase"))
    return w.select(F.col("window.start").alias("window_start"), *series,
                    F.col("increase").cast("bigint").alias("increase"),
                    F.round(F.col("increase") / F.lit(secs), 9).alias("rate"))


def last_not_null(samples: DataFrame, series=("job",), ts: str = "ts", value: str = "up",
                  tiebreak: str | None = "event_id") -> DataFrame:
    """The last non-NULL value per series (``lastNotNull``), as a ``max_by`` aggregate."""
    order = F.struct(F.col(ts), *([F.col(tiebreak)] if tiebreak else []))
    return (samples.filter(F.col(value).isNotNull()).groupBy(*series)
            .agg(F.max_by(F.col(value), order).alias(value), F.max(F.col(ts)).alias("last_ts")))


def time_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Dashboard range ``[now - 6h, now]`` with an explicit ``now``."""
    return df.filter((F.col(ts) >= as_timestamp(start)) & (F.col(ts) <= as_timestamp(end)))


def approx_latency_quantile(requests: DataFrame, q: float = 0.95, group_cols=("endpoint",), latency: str = "latency_s",
                            accuracy: int = 10000) -> DataFrame:
    """W5 variant on raw latencies: ``percentile_approx`` (a bounded-size sketch per group).

    An exact ``percentile`` would keep every distinct value of a group in one buffer, which a
    hot endpoint makes unbounded; the sketch merges map-side like any partial aggregate.
    """
    return requests.groupBy(*group_cols).agg(
        F.percentile_approx(F.col(latency), F.lit(q), F.lit(accuracy)).alias("quantile"))
