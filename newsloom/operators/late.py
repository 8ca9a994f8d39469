"""Late materialisation: which rows lose is decided on narrow columns, and only their identities meet the wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import checkpoint_dir

# A list of row identities up to this many bytes is broadcast, so that the wide rows aren't shuffled at all; a longer one
# meets them by a shuffle.
BROADCAST_BYTES = 32 << 20


def _meet(wide: DataFrame, rows: DataFrame, on: list[str], how: str, empty: DataFrame) -> DataFrame:
    """The rows are computed once into a reliable checkpoint, and their measured size decides how they meet the wide ones."""
    checkpoint_dir(rows.sparkSession)
    rows = rows.select(*[F.col(c).alias(f"_l_{c}") for c in on]).checkpoint(eager=True)
    width = F.lit(8)
    for f in rows.schema.fields:
        fixed = isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType))
        width = width + (F.lit(8) if fixed else F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 16)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if not n:
        return empty
    if size <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    cond = None
    for c in on:
        same = wide[c].eqNullSafe(F.col(f"_l_{c}"))
        cond = same if cond is None else cond & same
    return wide.join(rows, cond, how)


def drop_rows(wide: DataFrame, losers: DataFrame, on: list[str]) -> DataFrame:
    """``wide`` without the rows whose ``on`` columns (NULL is a value) are among ``losers``."""
    return _meet(wide, losers, on, "left_anti", wide)


def keep_rows(wide: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``wide`` whose ``on`` columns (NULL is a value) are among ``winners``."""
    return _meet(wide, winners, on, "left_semi", wide.limit(0))


def pick_rows(wide: DataFrame, key: str, order: list[Column], largest: bool = False) -> DataFrame:
    """One row per ``key`` (NULL is a value): that of the least (or largest) ``order``.

    Only keys with several rows are looked at further, and only on ``key`` and ``order``. Rows that share both are one row
    if ``order`` is total; end it with a digest of the row where it isn't.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ranked = wide.withColumn("_rank", rank)
    narrow = ranked.select(F.col(key).alias("_key"), "_rank")
    best = (narrow.groupBy("_key").agg((F.max if largest else F.min)("_rank").alias("_best"), F.count("*").alias("_n"))
            .where("_n > 1").withColumnRenamed("_key", "_k"))
    several = narrow.join(best, F.col("_key").eqNullSafe(F.col("_k"))).select("_key", "_rank", (F.col("_rank") == F.col("_best")).alias("_won"))
    checkpoint_dir(wide.sparkSession)
    several = several.groupBy("_key", "_rank", "_won").count().checkpoint(eager=True)
    kept = drop_rows(ranked, several.where("not _won").select(F.col("_key").alias(key), "_rank"), [key, "_rank"])
    twice = several.where("_won and count > 1").select(F.col("_key").alias(key))
    if twice.isEmpty():
        return kept.drop("_rank")
    same = F.col(key).eqNullSafe(F.col("_t"))
    again = kept.join(twice.withColumnRenamed(key, "_t"), same, "left_semi").dropDuplicates([key])
    return drop_rows(kept, twice, [key]).unionByName(again).drop("_rank")


def distinct_rows(wide: DataFrame) -> DataFrame:
    """``wide.distinct()`` where few rows repeat: only rows whose 64-bit hash occurs again meet in a shuffle and are compared
    whole, so rows that share a hash by chance stay apart."""
    hashed = wide.withColumn("_row_hash", F.xxhash64(*wide.columns))
    again = hashed.groupBy("_row_hash").count().where("count > 1").select("_row_hash")
    checkpoint_dir(wide.sparkSession)
    again = again.checkpoint(eager=True)
    if again.isEmpty():
        return wide
    once = drop_rows(hashed, again, ["_row_hash"]).drop("_row_hash")
    return once.unionByName(keep_rows(hashed, again, ["_row_hash"]).drop("_row_hash").distinct())
