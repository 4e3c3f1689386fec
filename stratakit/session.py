"""Spark session helpers.

Library code never creates its own cluster configuration: it uses whatever
session is active. ``local_session`` exists for tests, benches and the
command line, and only fills settings that are not already set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}

#: Scratch folders of local sessions; each removes itself at exit.
_SCRATCH: list[tempfile.TemporaryDirectory] = []


def scale_settings(input_bytes: int, cores: int, split_bytes: int = 512 << 20,
                   shuffle_partition_bytes: int = 1 << 30, max_shuffle_partitions: int = 50_000
                   ) -> dict[str, str]:
    """Size-dependent settings for a cluster session over ``input_bytes`` of
    Parquet on ``cores`` executor cores (the caller applies them when it
    builds its session; library code never does).

    Scan splits of ``split_bytes``; an initial shuffle width of one
    partition per ``shuffle_partition_bytes`` of input (at least two waves
    of the cores, at most ``max_shuffle_partitions`` so map x reduce shuffle
    blocks stay manageable), which AQE coalesces to the advisory size at run
    time and splits again where a join side is skewed."""
    width = -(-int(input_bytes) // shuffle_partition_bytes)
    parts = max(2 * int(cores), min(max_shuffle_partitions, width))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(int(split_bytes)),
        "spark.sql.shuffle.partitions": str(parts),
    }


def local_session(cores: int | str = "*", app: str = "stratakit") -> SparkSession:
    """Local session for tests and benches; cluster jobs bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as it is; if it
    is unset there, this raises, since a folder of one machine would lose data.
    Only a local session gets a scratch folder of its own, removed when the
    process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        scratch = tempfile.TemporaryDirectory(prefix="stratakit-ckpt-", ignore_cleanup_errors=True)
        _SCRATCH.append(scratch)
        configured = scratch.name
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used between long iterative stages (fold loops, searches) so a lost
    executor recomputes from the checkpoint, not from the raw scan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_at_once(spark: SparkSession, wanted: int, rows: int, row_bytes: int = 320) -> int:
    """How many of ``wanted`` tree fits may run at once, at least 1: each caches its ``rows`` (about
    ``row_bytes`` each), and what the executors' storage memory does not hold goes to their disks."""
    infos = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    room = sorted(i.totalOnHeapStorageMemory() for i in infos)
    held = sum(room) if len(room) < 2 else sum(room) - room[0]   # the driver caches nothing unless it is alone
    return max(1, min(wanted, held // max(1, rows * row_bytes)))


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Store a frame as Parquet in the shared checkpoint folder and read it
    back: computed once, columnar, and safe against lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
