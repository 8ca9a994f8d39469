"""J1 as merge-on-read: a table of appended versions, a view of the newest row per key, and a compaction job.

Every load writes one folder ``version=...`` and touches no other, so nothing that was read is ever overwritten and no folder
is deleted: a load that dies half-way leaves the table as it was, and one that is repeated under its version replaces just
itself. A key whose partition value moved, also to or from NULL, needs no search: its newest row wins wherever it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.late import drop_rows
from newsloom.operators.transform import mart_delta, mart_total
from newsloom.session import checkpoint_dir

VERSION = "version"


def version_name(number: int, run: str = "") -> str:
    """A version that sorts like its number; ``run`` keeps the loads of several writers apart."""
    return f"v{number:012d}{'-' + run if run else ''}"


def append_version(rows: DataFrame, path: str, version: str, keys, partition_col: str | None = None, unique: bool = False) -> None:
    """Writes ``rows`` as one version. As in MERGE, a key that the rows hold twice is an error (NULL counts as a value).

    ``unique`` says that ``rows`` are one per key by their making (a grouping by the keys), so they are not computed a
    second time to find that out.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    twice = None if unique else rows.groupBy(*keys).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"the source holds a key {twice['count']} times: {', '.join(f'{k}={twice[k]!r}' for k in keys)}")
    w = rows.drop(VERSION).write.mode("overwrite")
    if partition_col:
        w = w.partitionBy(partition_col)
    w.parquet(f"{path}/{VERSION}={version}")


def create(spark: SparkSession, path: str, schema: T.StructType, keys, partition_col: str | None = None) -> str:
    """An empty table: a first version without rows, partitioned like those that follow."""
    append_version(spark.createDataFrame([], schema), path, version_name(0, "empty"), keys, partition_col)
    return path


def all_versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of every version, with ``version``."""
    with_version = T.StructType([f for f in schema.fields if f.name != VERSION] + [T.StructField(VERSION, T.StringType())])
    return spark.read.schema(with_version).parquet(path)


def newest(rows: DataFrame, keys, order: list[Column] | None = None, where: Column | None = None) -> DataFrame:
    """The row of each key with the greatest ``order`` (default: its version); of equal orders the greater version.

    Winners are found on the keys and the order alone; only what identifies the losing rows meets the wide rows. ``where``
    restricts the result (it prunes the wide scan), not the search for winners.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rank = F.struct(*(order or []), F.col(VERSION))
    narrow = rows.select(*keys, VERSION, rank.alias("_rank"))
    best = narrow.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(F.max("_rank").alias("_best"))
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    losers = narrow.join(best, same).where(F.col("_rank") < F.col("_best")).select(*keys, VERSION)
    wide = rows if where is None else rows.where(where)
    return drop_rows(wide, losers, [*keys, VERSION])


def upsert(spark: SparkSession, path: str, source: DataFrame, version: str, keys="article_id",
           partition_col: str | None = "published_date") -> None:
    """``MERGE ON keys`` (update all columns, or insert): ``source`` becomes the table's newest version."""
    append_version(source, path, version, keys, partition_col)


def compact(spark: SparkSession, path: str, new_path: str, schema: T.StructType, keys, order: list[Column] | None = None,
            partition_col: str | None = None) -> str:
    """The newest rows as one version of a new table at ``new_path``; it bears the newest version's name, so later loads
    still win. Readers switch to the new place when the job is done, and the old one stays until they have."""
    rows = all_versions(spark, path, schema)
    last = rows.agg(F.max(VERSION)).first()[0] or version_name(0)
    append_version(newest(rows, keys, order), new_path, last, keys, partition_col)
    return new_path


IDS_SCHEMA = T.StructType([T.StructField("published_date", T.DateType()), T.StructField("source_name", T.StringType()),
                           T.StructField("article_id", T.StringType())])
DELTA_SCHEMA = T.StructType(IDS_SCHEMA.fields[:2] + [T.StructField(c, T.LongType()) for c in (
    "article_count", "sentiment_ready_count", "distinct_article_count")])


DAY = ["published_date", "source_name"]


def create_mart(spark: SparkSession, ids_path: str, deltas_path: str) -> None:
    create(spark, ids_path, IDS_SCHEMA, [*DAY, "article_id"])
    create(spark, deltas_path, DELTA_SCHEMA, DAY)


def add_arrival(spark: SparkSession, staged: DataFrame, ids_path: str, deltas_path: str, version: str) -> None:
    """A3 incrementally: one arrival's new ids and its delta become a version of either table; nothing is counted again.

    A repeated arrival replaces its own versions: its ids are compared with those of the other versions only.
    """
    known = all_versions(spark, ids_path, IDS_SCHEMA).where(F.col(VERSION) != version)
    checkpoint_dir(spark)
    new, delta = mart_delta(staged, known)
    delta = delta.checkpoint(eager=True)                # before the ids of this arrival are there
    append_version(new, ids_path, version, [*DAY, "article_id"])
    append_version(delta, deltas_path, version, DAY)


def mart(spark: SparkSession, deltas_path: str) -> DataFrame:
    """A3: the mart after all arrivals."""
    return mart_total(all_versions(spark, deltas_path, DELTA_SCHEMA))
