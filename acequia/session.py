"""Session helpers: settings for this library's jobs and the shared work folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes of a row group of intermediate tables. Readers take up to 4,096 rows at once, but
#: never of two row groups: without a bound, 4,096 packed series lie in a task's memory.
GROUP_BYTES = 2 << 20
#: Paths that ``scratch_path`` gave out.
_SCRATCH: list[str] = []


def build_session(app: str = "acequia", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; other settings come from the cluster."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as Spark's own settings name it.

    ``spark.checkpoint.dir`` if set, else the checkpoint folder of the context,
    else the warehouse; the scheme of the path, or the cluster's default file
    system, decides where it lies. The same rule holds on every master.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; never reused, so reruns cannot collide.

    ``discard_scratch`` deletes all that a session was given; it runs by itself
    when the driver's process ends in order.
    """
    path = f"{shared_folder(spark)}/acequia/{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_discard_at_exit)
    _SCRATCH.append(path)
    return path


def discard_scratch(spark: SparkSession) -> int:
    """Delete every intermediate table this process has written; returns how many there were.

    Results that were not written or collected yet may still read them, so it is
    called when a run has ended.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def _discard_at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            discard_scratch(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of a table several later jobs read, in a form that
    survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str, **metrics) -> tuple[DataFrame, dict]:
    """``materialize``, and its row count and further aggregates, observed while it is written."""
    seen = Observation(label)
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
    return materialize(counted, label), dict(seen.get)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session.

    Jobs with Python tasks then need no install on the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_acequia_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="acequia-py-")) / "acequia_package"
    context.addPyFile(
        shutil.make_archive(str(archive), "zip", root_dir=package.parent, base_dir=package.name)
    )
    context._acequia_shipped = True


def task_count(spark: SparkSession, items: int | None = None, per_task: int = 1) -> int:
    """Number of tasks for compute-heavy Python stages.

    Adaptive execution sizes partitions by bytes, and would put a small but
    slow-to-fit table into one task; these stages ask for their own count: one
    task for ``per_task`` items, and at least one for each core.
    """
    least = max(
        spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
    return max(least, -(-items // per_task)) if items else least
