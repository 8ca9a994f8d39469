"""Data-quality checks as DataFrames of failures (Q1-Q9).

Each check is one aggregate pass over its table and yields rows
``(model, column, test, failures)``; the suite is their union with a status column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.time import as_timestamp

# ---- fixed values: the declared column tests and freshness limits ------------------------------
SOURCE_TESTS = {"article_id": ("not_null", "unique"), "title": ("not_null",), "published_at": ("not_null",)}
STAGING_TESTS = {"article_id": ("not_null", "unique"), "title": ("not_null",), "source_name": ("not_null",),
                 "url": ("not_null",), "published_at": ("not_null",), "batch_id": ("not_null",)}
MART_TESTS = {"published_date": ("not_null",), "source_name": ("not_null",), "article_count": ("not_null",)}
FRESHNESS_WARN_HOURS = 24
FRESHNESS_ERROR_HOURS = 48
# --------------------------------------------------------------------------------------------------

RESULT_COLUMNS = ["model", "column", "test", "failures"]


def not_null(df: DataFrame, model: str, columns) -> DataFrame:
    """Q1: NULL count per column, all columns in one pass."""
    columns = list(columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(columns))
    return wide.select(F.lit(model).alias("model"),
                       F.expr(f"stack({len(columns)}, {pairs}) AS (column, failures)"),
                       F.lit("not_null").alias("test")).select(*RESULT_COLUMNS)


def unique(df: DataFrame, model: str, columns, name: str | None = None) -> DataFrame:
    """Q2/Q5: values (or key tuples) occurring more than once; NULLs ignored."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    keyed = df.filter(F.greatest(*[F.col(c).isNull() for c in columns]) == F.lit(False)) if len(columns) > 1 \
        else df.filter(F.col(columns[0]).isNotNull())
    dup = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(model).alias("model"), F.lit(name or ",".join(columns)).alias("column"),
        F.lit("unique").alias("test"), "failures")


def column_tests(df: DataFrame, model: str, tests: dict, materialize: bool = True) -> list[DataFrame]:
    """The declared tests of one model. With several checks on one model, the model is
    projected to the tested columns and materialised once (reliable checkpoint), so an
    expensive model (e.g. staging's Unicode trims) is computed once, not once per check."""
    nn = [c for c, ts in tests.items() if "not_null" in ts]
    uq = [c for c, ts in tests.items() if "unique" in ts]
    if materialize and (bool(nn) + len(uq)) > 1:
        df = df.select(*tests.keys()).checkpoint(eager=True)
    out = [not_null(df, model, nn)] if nn else []
    out += [unique(df, model, c) for c in uq]
    return out


def referential(edges: DataFrame, nodes: DataFrame, model: str = "edges") -> DataFrame:
    """Q8: edges whose endpoint is not a node (the rows J3 drops)."""
    ids = nodes.select(F.col("id")).distinct()
    miss = (edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
            .select("source_id", "target_id", "type")
            .unionByName(edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
                         .select("source_id", "target_id", "type"))
            .distinct())
    return miss.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(model).alias("model"), F.lit("source_id,target_id").alias("column"),
        F.lit("relationships").alias("test"), "failures")


def suite(checks: list[DataFrame]) -> DataFrame:
    """Q9: all results in one frame with a pass/fail status."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("failures", F.col("failures").cast("bigint")).withColumn(
        "status", F.when(F.col("failures") > 0, "fail").otherwise("pass"))


def freshness(df: DataFrame, source: str, loaded_at: str = "fetched_at", now=None,
              warn_hours: int = FRESHNESS_WARN_HOURS, error_hours: int = FRESHNESS_ERROR_HOURS) -> DataFrame:
    """Q3: age of the newest load; warn above ``warn_hours``, error above ``error_hours``."""
    agg = df.agg(F.max(F.col(loaded_at)).alias("max_loaded_at"))
    age = (F.unix_micros(as_timestamp(now)) - F.unix_micros(F.col("max_loaded_at"))) / F.lit(3.6e9)
    return agg.select(F.lit(source).alias("source"), "max_loaded_at", F.round(age, 6).alias("age_hours")).withColumn(
        "status", F.when(F.col("max_loaded_at").isNull(), "error")
                   .when(F.col("age_hours") > error_hours, "error")
                   .when(F.col("age_hours") > warn_hours, "warn").otherwise("pass"))


def range_violations(df: DataFrame, table: str, ranges: dict) -> DataFrame:
    """Q6: values outside ``[lo, hi]`` per column (None = unbounded), one pass."""
    cols = list(ranges)
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = ranges[c]
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < F.lit(lo))
        if hi is not None:
            bad = bad | (F.col(c) > F.lit(hi))
        aggs.append(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"_v{i}"))
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    pairs = ", ".join(
        f"'{c}', CAST({'NULL' if ranges[c][0] is None else float(ranges[c][0])} AS DOUBLE), "
        f"CAST({'NULL' if ranges[c][1] is None else float(ranges[c][1])} AS DOUBLE), _v{i}"
        for i, c in enumerate(cols))
    return wide.select(F.lit(table).alias("table"), "_rows",
                       F.expr(f"stack({len(cols)}, {pairs}) AS (column, lo, hi, violations)")
                       ).withColumnRenamed("_rows", "rows")


def schema_diff(df: DataFrame, expected: T.StructType, table: str = "table") -> DataFrame:
    """Q7: missing, extra and mistyped columns against the declared schema, plus NULL counts
    of the declared non-nullable columns (Q4, since Parquet does not enforce NOT NULL)."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = {f.name: f.dataType.simpleString() for f in expected.fields}
    required = [f.name for f in expected.fields if not f.nullable and f.name in actual]
    rows = []
    for name, typ in wanted.items():
        if name not in actual:
            rows.append((table, name, typ, None, "missing"))
        elif actual[name] != typ:
            rows.append((table, name, typ, actual[name], "mistyped"))
        else:
            rows.append((table, name, typ, actual[name], "ok"))
    rows += [(table, n, None, t, "extra") for n, t in actual.items() if n not in wanted]
    spark = df.sparkSession
    meta = spark.createDataFrame(rows, "table string, column string, expected string, actual string, issue string")
    nulls = not_null(df, table, required).select("column", F.col("failures").alias("null_count")) if required else \
        spark.createDataFrame([], "column string, null_count bigint")
    return meta.join(nulls, "column", "left")


def require(df: DataFrame, columns) -> tuple[DataFrame, DataFrame]:
    """Q4: split rows into (passing, quarantine with a reason) on required columns."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    tagged = df.withColumn("_missing", missing)
    ok = tagged.filter(F.size("_missing") == 0).drop("_missing")
    bad = tagged.filter(F.size("_missing") > 0).withColumn(
        "reason", F.concat(F.lit("missing required: "), F.array_join("_missing", ","))).drop("_missing")
    return ok, bad
