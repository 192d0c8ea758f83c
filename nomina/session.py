"""Session construction and cluster-safe helpers.

Cluster sizing notes (100 TB, ~1000 executors):
  * ``spark.sql.adaptive.enabled`` + ``coalescePartitions`` + ``skewJoin`` are
    always on: AQE re-plans joins from runtime sizes (sort-merge -> broadcast)
    and splits skewed shuffle partitions (one body may own a third of rows).
  * ``spark.sql.shuffle.partitions`` should be ~ input_bytes / 128 MB on a
    cluster; AQE coalesces it down for small stages.
  * ``spark.checkpoint.dir`` must name shared storage on a cluster. We only
    ever *read* it; a local fallback is created solely for ``local[...]``
    masters (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Engine defaults for sessions built here (AQE + skew join on, UTC so timestamp
# formatting matches the SQL oracle, no UI server).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 shuffle_bytes: int | None = None,
                 target_partition_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Sizing for a real cluster.

    Shuffle partitions follow the bytes that are *shuffled* (default: 1/8 of the input,
    since scans are column-pruned and aggregates combine map-side), at ~128 MB each and
    at least two waves of tasks; scan splits and the AQE advisory size use the same
    target so partitions fit in executor memory without spilling; skew handling kicks
    in for partitions 5x the median.
    """
    slots = executors * cores_per_executor
    shuffled = shuffle_bytes if shuffle_bytes is not None else input_bytes // 8
    parts = max(2 * slots, -(-shuffled // target_partition_bytes))
    size = f"{target_partition_bytes // (1024 * 1024)}m"
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "nomina", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults above."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf["spark.driver.memory"] = os.environ.get("NOMINA_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def app_id(spark: SparkSession) -> str:
    """Identity of the running application (used to key per-session memos)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        return spark.conf.get("spark.app.id", "nomina")


def default_parallelism(spark: SparkSession) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.default.parallelism", spark.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir; create a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must be set to shared storage on a cluster")
    path = tempfile.mkdtemp(prefix="nomina-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint dir for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


_BOUND_CACHE: dict[tuple[str, str, int], bool] = {}


def within_bound(spark: SparkSession, key: str, df: DataFrame, max_rows: int) -> bool:
    """Memoised ``rows(df) <= max_rows`` for an immutable input identified by ``key``
    (e.g. its path): the bounded count reads at most ``max_rows + 1`` rows, once per
    session.  Callers broadcast only when it holds; otherwise AQE picks the join
    from runtime statistics."""
    k = (app_id(spark), key, max_rows)
    if k not in _BOUND_CACHE:
        _BOUND_CACHE[k] = df.limit(max_rows + 1).count() <= max_rows
    return _BOUND_CACHE[k]
