"""Session settings and the shared scratch folder.

Scratch output (checkpoints, written reports) always goes under the folder
the cluster names in ``spark.checkpoint.dir``. A local temporary folder is
taken only by a local session that names none (tests, local runs); on any
other master its absence is an error, as executors could not share it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Local fallback folders per application, used only when the session names none.
_LOCAL_ROOTS: dict[str, str] = {}

# Settings that matter at scale: AQE re-plans joins at run time, splits
# skewed shuffle partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # the driver keeps run history for status queries even without the UI;
    # bound it so long-lived sessions do not slow down
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "10000",
    "spark.sql.ui.retainedExecutions": "50",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "poolshift", extra: dict | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Session with :data:`SCALE_CONF`. Master, shuffle partitions and driver
    memory are left to the submit options unless given here (the memory also
    by ``POOLSHIFT_DRIVER_MEMORY``, for local runs)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    memory = driver_memory or os.environ.get("POOLSHIFT_DRIVER_MEMORY")
    if memory:
        b = b.config("spark.driver.memory", memory)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_id(spark: SparkSession) -> str:
    """Application id."""
    return spark.sparkContext.applicationId


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir`` (a core setting, fixed when the
    session starts); only a local session that leaves it unset gets a
    temporary folder, once per application.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master {master!r})")
        app = app_id(spark)
        root = _LOCAL_ROOTS.get(app)
        if root is None:
            root = _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="poolshift-ckpt-")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared scratch folder."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


# AQE's first number of shuffle partitions; it joins small ones again.
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Rows that a task of a shuffle should hold at most, about 100 MB of wide rows.
ROWS_PER_SHUFFLE_TASK = 200_000


def shuffle_tasks(spark: SparkSession) -> int:
    """Tasks that a shuffle of this session is dealt to."""
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(fixed, int(spark.conf.get(INITIAL_PARTITIONS, None) or 0))


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Let the session's shuffles begin with as many partitions as ``rows``
    input rows need, so that what a task holds does not grow with the input.
    Only ever raises the number; AQE joins partitions that turn out small."""
    wanted = -(-rows // ROWS_PER_SHUFFLE_TASK)
    if wanted > shuffle_tasks(spark):
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))


# Compressed bytes that AQE joins to one task of a shuffle, and file bytes of
# one task of a scan, at most: tables of short repeating texts take some 70
# times that much room while they are aggregated.
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPLIT = "spark.sql.files.maxPartitionBytes"
TASK_BYTES = {ADVISORY: 4 << 20, SPLIT: 32 << 20}


def size_in_bytes(text: str) -> int:
    """Bytes of a size setting (``64MB``, ``8m``, ``1024``)."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def bound_tasks(spark: SparkSession) -> None:
    """Hold the session's tasks to :data:`TASK_BYTES`. By its own settings Spark
    deals a larger input to the same number of larger tasks, whose memory grows
    with it. Only ever lowers the settings."""
    for name, most in TASK_BYTES.items():
        if size_in_bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss); rows keep their order."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, in any order.

    Against :func:`cut_lineage`: computed once, compressed, columns stay
    prunable, and the planner knows the size, so that a small table is
    broadcast and does not have the rows it meets dealt by a few keys.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
