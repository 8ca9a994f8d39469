"""Telemetry operators against hand-computed values and a pure-Python counter model."""

import datetime as dt
import random

from pyspark.sql import functions as F

from newsloom.operators import telemetry


def reqs(spark, rows):
    return spark.createDataFrame(rows, "ts string, endpoint string, status int, latency_s double, method string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def test_histogram_quantile_interpolates(spark):
    # 10 requests: 4 at 0.02 (bucket 0.025), 6 at 0.3 (bucket 0.5)
    rows = [("2024-01-01 00:00:00", "/p", 200, 0.02, "GET")] * 4 + [("2024-01-01 00:00:00", "/p", 200, 0.3, "GET")] * 6
    q = telemetry.latency_quantile(reqs(spark, rows), 0.95).first().quantile
    # rank 9.5 lands in (0.25, 0.5]: cum before = 4, in-bucket = 6 -> 0.25 + 0.25 * (5.5 / 6)
    assert abs(q - (0.25 + 0.25 * 5.5 / 6)) < 1e-12
    inf = telemetry.latency_quantile(reqs(spark, [("2024-01-01 00:00:00", "/p", 200, 50.0, "GET")]), 0.95).first()
    assert inf.quantile == 10.0


def test_buckets_are_cumulative(spark):
    rows = [("2024-01-01 00:00:00", "/p", 200, v, "GET") for v in (0.001, 0.2, 3.0, 20.0)]
    h = {r.le: r.bucket_count for r in telemetry.latency_buckets(reqs(spark, rows)).collect()}
    assert (h["0.005"], h["0.25"], h["5.0"], h["10.0"], h["+Inf"]) == (1, 2, 3, 3, 4)


def test_counter_increase_matches_python_across_chunks(spark):
    rnd = random.Random(7)
    rows, value = [], 0
    t = dt.datetime(2024, 1, 1)
    for i in range(300):
        t += dt.timedelta(minutes=rnd.randint(1, 40))
        value = 0 if rnd.random() < 0.05 else value + rnd.randint(0, 5)
        rows.append(("/a", t.strftime("%Y-%m-%d %H:%M:%S"), i, value))
    df = spark.createDataFrame(rows, "endpoint string, ts string, event_id int, value int") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.event_id: r.increase for r in telemetry.counter_increase(df, chunk="hour").collect()}
    prev = None
    for _, _, i, v in rows:
        exp = 0 if prev is None else (v if v < prev else v - prev)
        assert got[i] == exp
        prev = v


def test_rates_and_5xx(spark):
    rows = [("2024-01-01 00:00:30", "/p", 200, 0.1, "GET"), ("2024-01-01 00:02:00", "/p", 500, 0.1, "GET"),
            ("2024-01-01 00:02:10", "/p", 503, 0.1, "GET")]
    r = {(str(x.window_start), x.endpoint): x.requests for x in telemetry.request_rate(reqs(spark, rows)).collect()}
    assert r[("2024-01-01 00:00:00", "/p")] == 3 and r[("2024-01-01 00:01:00", "/p")] == 2
    e = {str(x.window_start): x.requests for x in telemetry.error_rate(reqs(spark, rows)).collect()}
    assert e["2024-01-01 00:02:00"] == 2 and "2023-12-31 23:56:00" not in e


def test_route_templates_and_failures(spark):
    df = spark.createDataFrame([("GET", "/model/resnet/details", None), ("GET", "/health", 200)],
                               "method string, endpoint string, status int")
    out = sorted((r.endpoint, r.status) for r in telemetry.request_counts(df).collect())
    assert out == [("/health", 200), ("/model/{name}/details", 500)]


def test_last_not_null(spark):
    df = spark.createDataFrame([("j", "2024-01-01 00:00:00", 1, 1), ("j", "2024-01-01 00:01:00", 2, None)],
                               "job string, ts string, event_id int, up int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert telemetry.last_not_null(df).first().up == 1


def test_approx_quantile_close_to_exact(spark):
    rows = [("2024-01-01 00:00:00", "/p", 200, i / 1000.0, "GET") for i in range(1, 1001)]
    q = telemetry.approx_latency_quantile(reqs(spark, rows), 0.95).first().quantile
    assert abs(q - 0.95) <= 0.002


def _py_histogram_quantile(q, values, buckets=telemetry.DEFAULT_BUCKETS):
    """Pure-Python model of the bucket rule (cumulative counts, linear interpolation)."""
    total = len(values)
    if total == 0:
        return None
    cum = [sum(1 for v in values if v <= b) for b in buckets]
    rank = q * total
    for i, c in enumerate(cum):
        if c >= rank:
            lo = buckets[i - 1] if i > 0 else 0.0
            prev = cum[i - 1] if i > 0 else 0
            cnt = c - prev
            return lo + (buckets[i] - lo) * ((rank - prev) / cnt) if cnt > 0 else lo
    return buckets[-1]


def test_histogram_quantile_matches_python_model(spark):
    rnd = random.Random(11)
    groups = {f"/e{g}": [rnd.choice([rnd.random() * 0.1, rnd.random() * 3, rnd.random() * 30]) for _ in range(rnd.randint(1, 60))]
              for g in range(40)}
    rows = [("2024-01-01 00:00:00", e, 200, v, "GET") for e, vs in groups.items() for v in vs]
    for q in (0.5, 0.95, 0.99):
        got = {r.endpoint: r.quantile for r in telemetry.latency_quantile(reqs(spark, rows), q).collect()}
        for e, vs in groups.items():
            assert abs(got[e] - _py_histogram_quantile(q, vs)) < 1e-9, (e, q)
