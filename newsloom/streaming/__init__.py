"""Structured Streaming forms of ingestion, dedup, request rate and audit."""

from contextlib import contextmanager

from pyspark.sql import SparkSession

# Input of one micro-batch: sized by bytes, so the number of batches follows the data and not the number of files.
BYTES_PER_TRIGGER = 8 << 30

# State of the id dedup can reach many GB at scale (e.g. 31 days of article ids): keep it in
# RocksDB on local disk with changelog checkpoints, not on the JVM heap.
STATE_STORE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_CHANGELOG_KEY = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Start the queries of this block with the RocksDB state store (the provider is fixed when
    a query starts and recorded in its checkpoint), unless the session chose a provider itself;
    the session's previous settings are restored afterwards."""
    before = {k: spark.conf.get(k, None) for k in (_PROVIDER_KEY, _CHANGELOG_KEY)}
    chosen = before[_PROVIDER_KEY]
    if not chosen or chosen.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER_KEY, STATE_STORE_PROVIDER)
        spark.conf.set(_CHANGELOG_KEY, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
