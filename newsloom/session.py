"""Session defaults and the shared scratch location.

Scratch data (landed files, rebuilt tables, streaming checkpoints) always goes under the
cluster's ``spark.checkpoint.dir`` so every executor sees it and it survives executor loss.
A directory of our own is only chosen when the session has none (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the operators rely on. The session zone must be UTC: every
# timestamp in the data model is an instant and every date is the UTC date of it.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # of a repeated key of a JSON object the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Broadcast policy: never broadcast on a planning-time estimate (a compressed file size is
    # no bound on the in-memory size); AQE converts a join to a broadcast join only when the
    # measured size of a materialised shuffle stage is below the adaptive threshold.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Joins by long text keys: where every partition of a side is measured below this, AQE hashes that side instead of
    # sorting both.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def ensure_session_defaults(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(master: str = "local[*]", app: str = "newsloom", shuffle_partitions: int = 8,
                extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in {**RUNTIME_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_session_defaults(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; set one of our own only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (sessions without a local SparkContext)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current.rstrip("/")
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    else:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder "
                               "(lineage cuts, scratch tables and stream checkpoints are written there)")
        configured = tempfile.mkdtemp(prefix="newsloom-ckpt-")      # local mode (tests) only
    if sc is not None:
        sc.setCheckpointDir(configured)
        return (sc.getCheckpointDir() or configured).rstrip("/")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex[:12]}"


def sizing_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Spill-aware sizing for a job reading ``input_bytes`` on ``total_cores`` task slots.

    Shuffle partitions are sized so one partition holds about ``target_partition_bytes`` of the
    input (at least two waves of tasks), file splits never exceed the target, and AQE coalesces
    small partitions back towards it. At 100 TB and 256 MB that is ~400k shuffle partitions.
    """
    by_size = -(-int(input_bytes) // int(target_partition_bytes))
    parts = max(2 * total_cores, by_size)
    parts = -(-parts // total_cores) * total_cores          # whole waves
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(target_partition_bytes, 256 << 20)),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 << 20)),
    }
