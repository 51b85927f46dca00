"""Session set-up: runtime SQL settings, checkpoint folder, and the size checks the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every plan relies on; all can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a union that claims its children's partitioning breaks joins over cached blocks re-planned at run time
    "spark.sql.unionOutputPartitioning": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one up only for a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wardlens-checkpoint-"))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small single-file scan enough partitions for the cores; leave large scans as they were read.

    A table below one input split per core arrives in a few partitions and leaves cores idle, so moving it
    is cheap. A large table already has more splits than cores, and no exchange is added for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < cores * 128 * 1024 * 1024:
        return df.repartition(cores, *keys)
    return df


# Bytes of a partition whose rows are folded by key, and rows of a table that is sent whole to every executor.
KEYED_BYTES, MOST_SENT = 4 * 1024 * 1024, 1_000_000
# Partitions by key at most, and an estimate that says nothing of a size.
MOST_KEYED, UNKNOWN_BYTES = 10_000, 1 << 50


def keyed(df: DataFrame, key: str, size: int = KEYED_BYTES) -> DataFrame:
    """The rows of a key in one partition, in partitions of bounded size.

    Folding by the key, or by the key and more, then needs no further exchange, and what is sorted for it fits in memory.
    """
    known = plan_bytes(df)
    if known > UNKNOWN_BYTES:
        return df.repartition(key)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, min(known // size, MOST_KEYED)), key)


def sent(table: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """A lookup table, written once, and whether it is small enough to be broadcast; it is marked so if it is."""
    written = materialize(table, name)
    if written.count() > (MOST_SENT if most is None else most):
        return written, False
    return F.broadcast(written), True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name for files that several executors read, under the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several jobs read, and go on from the written table.

    The plan behind it is then run once and not analysed again by every job of an iterative fit, and a lost
    executor costs a read of the table instead of a new run of the plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
