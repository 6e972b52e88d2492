"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs were tuned with. On a cluster pass them at submit time; shuffle
#: partitions are deliberately left to the cluster (AQE coalesces downwards from there).
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key also where the next grouping has the same key and so needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state on disk instead of the heap; written checkpoints go when nothing refers to them.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "fieldtally", cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    partitions = "8" if cores == "*" else str(cores)
    session = (
        builder.config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def tune(spark: SparkSession) -> SparkSession:
    """Switch on, in a running session, the recommended settings that may change at run time.

    Settings of storage, memory and shuffle width are left to the cluster.
    """
    for key, value in RECOMMENDED.items():
        if key.startswith("spark.sql.adaptive."):
            spark.conf.set(key, value)
    return spark


def shuffle_tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has, for rows whose work or result their size does not tell: ``repartition`` by a number is left as it is."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="fieldtally-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables that outlive one stage."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written copy.

    Used where several branches read the same aggregate, or where a non-deterministic
    column (a sort position) must not be computed twice. The copy survives lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
