"""ST4: audit events as an append-only stream (file sink, exactly-once via its commit log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.sources.audit import audit_events
from newsloom.streaming import BYTES_PER_TRIGGER


def land_events(df: DataFrame, path: str, parts: int = 4, key: str = "event_id") -> None:
    from pyspark.sql import functions as F
    for k in range(parts):
        df.filter(F.pmod(F.col(key), F.lit(parts)) == k).write.mode("append").parquet(path)


def audit_stream(spark: SparkSession, landing: str, schema, sink: str, checkpoint: str, bytes_per_trigger: int = BYTES_PER_TRIGGER):
    events = audit_events(spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger)
                          .parquet(landing))
    q = (events.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
