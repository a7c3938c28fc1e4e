"""Session helpers shared by the entry points, the bench and the tests."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[tuple[SparkSession, str]] = []


def build_session(cpus: str | int = "*", shuffle_partitions: int | None = None, app: str = "panelmill") -> SparkSession:
    """Session for local runs; on a cluster use the session you already have."""
    cores = os.cpu_count() if cpus in ("*", None) else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        # window work is heavy per byte: do not fold a small local shuffle into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder only when none is named."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelmill-ckpt-"))


def settle(df: DataFrame) -> DataFrame:
    """Write a derived table once and read it back where several passes follow.

    Survives the loss of executors and keeps the passes from planning and running the whole lineage again. (A reliable
    checkpoint would run the last stage twice, once to count and once to write.)
    """
    return written(df)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the checkpoint folder; what is written there is removed when the application ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """Write a wide derived table under the checkpoint folder and read it back; removed when the application ends.

    Unlike ``settle`` the result carries nothing of the plan it came from (a checkpoint keeps the constraints of its
    lineage, and each later filter walks them), nor its partitions.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _WRITTEN:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone already  # noqa: BLE001
            return
